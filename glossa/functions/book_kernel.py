"""Kernels for compiled books: variable integers, trailers, the three text compressions, index rows, edit programs.

All raise ``BookError`` with a code instead of guessing. They work on one
record or one book; tables of books run them as Arrow kernels.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

NONE = 0xFFFFFFFF


class BookError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def cut(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or n < 0 or at + n > len(data):
        raise BookError("MALFORMED", f"{n} bytes at {at} of {len(data)}")
    return data[at : at + n]


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(cut(data, at, 2), "big")


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(cut(data, at, 4), "big")


def vint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset) of a base-128 integer whose last byte has the high bit."""
    value = 0
    for i in range(5):
        b = cut(data, at + i, 1)[0]
        value = value << 7 | b & 127
        if b & 128:
            if value > NONE:
                break
            return value, at + i + 1
    raise BookError("MALFORMED", "variable integer")


def decode(data: bytes, encoding: int) -> str:
    """UTF-8 or Windows-1252 text without NUL; the five undefined bytes of the latter are C1 controls."""
    if encoding not in (65001, 1252):
        raise BookError("UNSUPPORTED", f"encoding {encoding}")
    if b"\0" in data:
        raise BookError("MALFORMED", "NUL in text")
    try:
        return data.decode() if encoding == 65001 else "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)
    except UnicodeDecodeError as e:
        raise BookError("MALFORMED", str(e)) from e


def strip_trailers(record: bytes, flags: int) -> bytes:
    """The record without the trailers that the flag bits name, the highest first."""
    end = len(record)
    for _ in range(bin(flags >> 1 & 0x7FFF).count("1")):
        size = 0
        for i in range(4):
            b = cut(record, end - 1 - i, 1)[0]
            size |= (b & 127) << 7 * i
            if b & 128:
                break
        else:
            raise BookError("MALFORMED", "trailer length")
        if size <= i or size > end:
            raise BookError("MALFORMED", "trailer length")
        end -= size
    if flags & 1:
        end -= (cut(record, end - 1, 1)[0] & 3) + 1
        if end < 0:
            raise BookError("MALFORMED", "multibyte trailer")
    return record[:end]


def palmdoc(data: bytes, cap: int) -> bytes:
    """Literals, runs of 1 to 8 raw bytes, a space and a character, and back references."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if b == 0 or 9 <= b < 128:
            out.append(b)
        elif b < 9:
            out += cut(data, i, b)
            i += b
        elif b >= 192:
            out += bytes((32, b ^ 128))
        else:
            pair = b << 8 | cut(data, i, 1)[0]
            i += 1
            back, n = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise BookError("MALFORMED", "back reference before the text")
            for _ in range(n):
                out.append(out[-back])
        if len(out) > cap:
            raise BookError("LIMIT", "decompressed text")
    return bytes(out)


def pack_palmdoc(data: bytes) -> bytes:
    """A plain packer: back references of 3 to 10 bytes within 2047, spaces with letters, literals."""
    out, i, seen = bytearray(), 0, {}
    while i < len(data):
        at = seen.get(data[i : i + 3])
        if at is not None and i - at < 2048 and i + 3 <= len(data):
            n = 3
            while n < 10 and i + n < len(data) and data[at + n] == data[i + n]:
                n += 1
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | n - 3)
        elif data[i] == 32 and i + 1 < len(data) and 64 <= data[i + 1] < 128:
            out.append(data[i + 1] ^ 128)
            n = 2
        elif data[i] == 0 or 9 <= data[i] < 128:
            out.append(data[i])
            n = 1
        else:
            n = 1
            while n < 8 and i + n < len(data) and (1 <= data[i + n] < 9 or data[i + n] >= 128):
                n += 1
            out.append(n)
            out += data[i : i + n]
        for k in range(i, i + n):
            seen[data[k : k + 3]] = k
        i += n
    return bytes(out)


class Huff:
    """Canonical codes whose phrases may hold coded phrases."""

    DEPTH = 64

    def __init__(self, table: bytes, dictionaries: list[bytes], most: int = 2_000_000):
        self.quick, self.low, self.high = self._ranges(table)
        self.phrases = [p for part in self._parts(dictionaries, most) for p in part]

    @staticmethod
    def _ranges(table: bytes):
        """The entries by leading byte, and for each code length the least and the greatest code, left-aligned in 32 bits."""
        magic, size, quick, limits = struct.unpack(">4s3I", cut(table, 0, 16))
        if magic != b"HUFF" or size < 24:
            raise BookError("MALFORMED", "code table header")
        low, high = [0], [0]
        for n, (first, last) in enumerate(struct.iter_unpack(">2I", cut(table, limits, 8 * 32)), 1):
            low.append(first << 32 - n)
            high.append(max(0, (last + 1 << 32 - n) - 1))
        return struct.unpack(">256I", cut(table, quick, 4 * 256)), low, high

    @staticmethod
    def _parts(records: list[bytes], most: int):
        """The (phrase, is literal) pairs of each record; every record but the last holds the same power of two."""
        heads = {cut(r, 0, 16) for r in records}
        if len(heads) != 1:
            raise BookError("MALFORMED", "phrase record headers differ" if heads else "no phrase record")
        magic, size, total, width = struct.unpack(">4s3I", heads.pop())
        if magic != b"CDIC" or size != 16:
            raise BookError("MALFORMED", "phrase record header")
        if not (1 <= total <= most and 1 <= width <= 16):
            raise BookError("LIMIT", "phrase table")
        counts = [min(1 << width, total - at) for at in range(0, total, 1 << width)]
        if len(records) != len(counts):
            raise BookError(*(("MALFORMED", "a record more than phrases") if len(records) > len(counts) else ("INCOMPLETE", "phrase count")))
        for record, n in zip(records, counts, strict=True):
            places = struct.unpack(f">{n}H", cut(record, 16, 2 * n))
            if min(places) < 2 * n:
                raise BookError("MALFORMED", "phrase over the offset table")
            sizes = [u16(record, 16 + at) for at in places]
            yield [(cut(record, 18 + at, size & 0x7FFF), size > 0x7FFF) for at, size in zip(places, sizes, strict=True)]

    def _codes(self, data: bytes):
        """Phrase numbers coded in the data; an incomplete last code is padding."""
        left, word = 8 * len(data), int.from_bytes(data, "big")
        while left:
            code = word >> left - 32 if left >= 32 else word << 32 - left
            code &= NONE
            entry = self.quick[code >> 24]
            n = entry & 31
            if n == 0:
                raise BookError("MALFORMED", "code of no length")
            if entry & 0x80:
                top = ((entry >> 8) + 1 << 32 - n) - 1
            else:
                while n <= 32 and code < self.low[n]:
                    n += 1
                if n > 32:
                    raise BookError("MALFORMED", "code outside the tables")
                top = self.high[n]
            if n > left:
                return
            if code > top:
                raise BookError("MALFORMED", "code above the maximum")
            left -= n
            word &= (1 << left) - 1
            yield top - code >> 32 - n

    def decompress(self, data: bytes, cap: int, budget: list[int]) -> bytes:
        """Expanded text; ``budget`` holds the operations left and is charged."""
        out, size = [], 0
        stack = [(self._codes(data), -1)]
        while stack:
            number = next(stack[-1][0], None)
            if number is None:
                stack.pop()
                continue
            budget[0] -= 1
            if budget[0] < 0:
                raise BookError("LIMIT", "operations")
            if number >= len(self.phrases):
                raise BookError("MALFORMED", "phrase out of range")
            text, literal = self.phrases[number]
            if literal:
                out.append(text)
                size += len(text)
                if size > cap:
                    raise BookError("LIMIT", "decompressed text")
            else:
                if any(number == n for _, n in stack):
                    raise BookError("MALFORMED", "cyclic phrase")
                if len(stack) > self.DEPTH:
                    raise BookError("LIMIT", "phrase depth")
                stack.append((self._codes(text), number))
        return b"".join(out)


def edit_word(base: bytes, program: bytes, cap: int = 4096) -> bytes:
    """A word changed by an edit program.

    1 to 4 choose insertion (1, 2) or deletion (3, 4) towards the right (1, 4)
    or left (2, 3); 11 to 19 move the cursor left by 1 to 9; 20 and above are
    bytes to insert or delete; 0 ends. A program begins as if it had chosen
    insertion towards the left, at the word's end.
    """
    word, at, insert, side = bytearray(base), len(base), True, "left"
    for i, b in enumerate(program):
        if b == 0:
            if any(program[i:]):
                raise BookError("MALFORMED", "code after the end")
            break
        if b <= 4:
            new = "left" if b in (2, 3) else "right"
            if side != new and side != "hold":
                at = len(word) if new == "left" else 0
            insert, side = b <= 2, new
        elif 11 <= b <= 19:
            if side == "right":
                at = len(word)
            at -= b - 10
            if at < 0:
                raise BookError("MALFORMED", "cursor before the word")
            side = "hold"
        elif b < 20:
            raise BookError("UNSUPPORTED", f"edit code {b}")
        elif insert:
            word.insert(at, b)
            at += side == "right"
        else:
            at -= side == "left"
            if not 0 <= at < len(word) or word[at] != b:
                raise BookError("MALFORMED", "deletion does not match")
            del word[at]
        if len(word) > cap:
            raise BookError("LIMIT", "edited word")
    if not word:
        raise BookError("MALFORMED", "empty word")
    return bytes(word)


class Row(NamedTuple):
    label: bytes
    tags: dict[int, list[int]]
    record: int


def read_tags(data: bytes, at: int, controls: int, descriptors: list[tuple[int, int, int, int]]) -> tuple[dict[int, list[int]], int]:
    """Tag values of an index row: control bits say how many tuples, or how many bytes of them, follow."""
    bits = cut(data, at, controls)
    at += controls
    used, number, plan = [0] * controls, 0, []
    for tag, arity, mask, end in descriptors:
        if end:
            number += 1
            continue
        if number >= controls or not mask or not arity or used[number] & mask:
            raise BookError("MALFORMED", "tag descriptor")
        used[number] |= mask
        hit = bits[number] & mask
        if not hit:
            continue
        if any(tag == p[0] for p in plan):
            raise BookError("UNSUPPORTED", "tag described twice")
        if hit == mask and mask & mask - 1:
            size, at = vint(data, at)
            plan.append((tag, arity, None, size))
        else:
            plan.append((tag, arity, 1 if hit == mask else hit // (mask & -mask), None))
    if any(b & ~u & 0xFF for b, u in zip(bits, used, strict=True)):
        raise BookError("UNSUPPORTED", "unmapped control bits")
    tags: dict[int, list[int]] = {}
    for tag, arity, tuples, size in plan:
        values = tags[tag] = []
        stop = at + size if size is not None else None
        if stop is not None:
            cut(data, at, size)
        while at < stop if stop is not None else len(values) < tuples * arity:
            value, at = vint(data[:stop], at)
            values.append(value)
        if len(values) % arity:
            raise BookError("MALFORMED", "incomplete tuple")
    return tags, at


class Index:
    """An index: its meta record, rows in order, and the records of its strings."""

    def __init__(self, records: list[bytes], start: int, most: int = 2_000_000):
        meta = self._record(records, start)
        head = u32(meta, 4)
        if cut(meta, head, 4) != b"TAGX":
            raise BookError("UNSUPPORTED", "index without tag descriptors")
        n, declared = u32(meta, 24), u32(meta, 36)
        if declared > most or start + n >= len(records):
            raise BookError("LIMIT", "index rows or records")
        if u32(meta, 48):
            raise BookError("UNSUPPORTED", "ligature table")
        code = u32(meta, 28)
        self.encoding = {NONE: 1252, 65002: 65001}.get(code, code)
        self.width, self.codes = 0, ()
        if head >= 180 and u32(meta, 168):
            self.width, at = u32(meta, 164), u32(meta, 176)
            if self.width not in (1, 2) or cut(meta, at, 4) != b"ORDT" or u32(meta, 168) > 65536:
                raise BookError("MALFORMED", "order table")
            self.codes = struct.unpack(f">{u32(meta, 168)}H", cut(meta, at + 4, 2 * u32(meta, 168)))
        size, controls = u32(meta, head + 4), u32(meta, head + 8)
        if size < 12 or size % 4 or controls > 64:
            raise BookError("MALFORMED", "tag descriptors")
        self.descriptors = list(struct.iter_unpack("4B", cut(meta, head + 12, size - 12)))
        if sum(d[3] for d in self.descriptors) != controls or any(d[3] > 1 for d in self.descriptors):
            raise BookError("MALFORMED", "control bytes")
        self.rows = [row for r in range(start + 1, start + 1 + n) for row in self._rows(records, r, controls)]
        if len(self.rows) != declared:
            raise BookError("INCOMPLETE", "index rows")
        self.strings = list(range(start + 1 + n, start + 1 + n + u32(meta, 52)))
        if self.strings and self.strings[-1] >= len(records):
            raise BookError("MALFORMED", "string records")
        self.records = records

    @staticmethod
    def _record(records: list[bytes], n: int) -> bytes:
        if not 0 <= n < len(records) or cut(records[n], 0, 4) != b"INDX":
            raise BookError("MALFORMED", f"record {n} is no index record")
        return records[n]

    def _rows(self, records: list[bytes], number: int, controls: int):
        data = self._record(records, number)
        head, table, n = u32(data, 4), u32(data, 20), u32(data, 24)
        if table < head or cut(data, table, 4) != b"IDXT":
            raise BookError("MALFORMED", "row offsets")
        offsets = [*struct.unpack(f">{n}H", cut(data, table + 4, 2 * n)), table]
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if not head <= a < b <= table:
                raise BookError("MALFORMED", "row order")
            row = data[a:b]
            label = cut(row, 1, row[0])
            tags, end = read_tags(row, 1 + len(label), controls, self.descriptors)
            if any(row[end:]) or len(row) - end > (3 if i + 1 == n else 0):
                raise BookError("UNSUPPORTED", "bytes after a row")
            yield Row(label, tags, number)

    def require(self, *tags: int) -> None:
        for tag, _, _, end in self.descriptors:
            if not end and tag not in tags:
                raise BookError("UNSUPPORTED", f"tag {tag}")

    def has(self, tag: int) -> bool:
        return any(d[0] == tag and not d[3] for d in self.descriptors)

    def text(self, label: bytes) -> str:
        """A label's text; with an order table its codes stand for UTF-16 units."""
        if not self.codes:
            return decode(label, self.encoding)
        if len(label) % self.width:
            raise BookError("MALFORMED", "odd label")
        codes = label if self.width == 1 else struct.unpack(f">{len(label) // 2}H", label)
        units = [self.codes[c] if c < len(self.codes) else c for c in codes]
        if any(u <= 5 for u in units):
            raise BookError("UNSUPPORTED", "ligature in a label")
        try:
            return struct.pack(f">{len(units)}H", *units).decode("utf-16-be")
        except UnicodeDecodeError as e:
            raise BookError("MALFORMED", "surrogates in a label") from e

    def bytes_at(self, offset: int, n: int | None = None) -> bytes:
        """``n`` bytes of the string records, or a string that begins with its length."""
        if offset >> 16 >= len(self.strings):
            raise BookError("MALFORMED", "string segment")
        data, at = self.records[self.strings[offset >> 16]], offset & 0xFFFF
        if n is None:
            n, at = vint(data, at)
        return cut(data, at, n)


def scalar(row: Row, tag: int) -> int:
    values = row.tags.get(tag, [])
    if len(values) != 1:
        raise BookError("MALFORMED", f"tag {tag} has {len(values)} values")
    return values[0]


def old_suffixes(index: Index) -> dict[bytes, list[bytes]]:
    """Suffix -> endings that replace it, from the older kind of inflection index."""
    index.require(7)
    out: dict[bytes, list[bytes]] = {}
    for row in index.rows:
        pairs = row.tags.get(7)
        if pairs is None or len(pairs) % 2:
            raise BookError("UNSUPPORTED", "inflection row")
        for n, offset in zip(pairs[::2], pairs[1::2], strict=True):
            out.setdefault(index.bytes_at(offset, n), []).append(row.label)
    return out


def old_aliases(word: bytes, suffixes: dict[bytes, list[bytes]], longest: int) -> list[bytes]:
    """Forms of a word, by the shortest matching suffix first."""
    return [word[: len(word) - n] + new for n in range(min(len(word), longest) + 1) for new in suffixes.get(word[len(word) - n :], ())]


def new_aliases(row: Row, index: Index) -> list[tuple[bytes, str]]:
    """(form, name of its group) by the edit programs that the row's groups refer to."""
    index.require(5, 26)
    out = []
    for g in row.tags.get(42, ()):
        if g >= len(index.rows):
            raise BookError("MALFORMED", "inflection group")
        names, rules = index.rows[g].tags.get(5), index.rows[g].tags.get(26)
        if names is None or rules is None or len(names) != len(rules):
            raise BookError("INCOMPLETE", "names and rules of a group")
        for name, rule in zip(names, rules, strict=True):
            if rule >= len(index.rows):
                raise BookError("MALFORMED", "inflection rule")
            out.append((edit_word(row.label, index.rows[rule].label), decode(index.bytes_at(name), index.encoding)))
    return out
