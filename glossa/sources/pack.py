"""A plain writer of compiled books, for books made in code: one index record, any number of text records."""

from __future__ import annotations

import struct

from glossa.functions.book_kernel import NONE, pack_palmdoc


def vint(n: int) -> bytes:
    out = [n & 127 | 128]
    while n := n >> 7:
        out.insert(0, n & 127)
    return bytes(out)


def index(rows: list[bytes], tagx: list[tuple[int, int, int, int]], strings: list[bytes] = ()) -> list[bytes]:
    """Meta record, one record of rows, and string records."""
    head = 192
    controls = sum(t[3] for t in tagx)
    meta = bytearray(head)
    meta[0:4] = b"INDX"
    struct.pack_into(">I", meta, 4, head)
    struct.pack_into(">II", meta, 24, 1, 65001)
    struct.pack_into(">I", meta, 36, len(rows))
    struct.pack_into(">I", meta, 52, len(strings))
    meta += b"TAGX" + struct.pack(">II", 12 + 4 * len(tagx), controls) + b"".join(bytes(t) for t in tagx)
    data, offsets = bytearray(head), []
    data[0:4] = b"INDX"
    struct.pack_into(">I", data, 4, head)
    for r in rows:
        offsets.append(len(data))
        data += r
    struct.pack_into(">II", data, 20, len(data), len(rows))
    data += b"IDXT" + struct.pack(f">{len(rows)}H", *offsets)
    return [bytes(meta), bytes(data), *strings]


def row(label: bytes, controls: bytes, *values: int) -> bytes:
    return bytes([len(label)]) + label + controls + b"".join(map(vint, values))


def book(text: bytes, entries: list[tuple[str, int, int]], compression: int = 2, images: list[bytes] = (), title: str = "A Book", block: int = 64, forms: bool = True) -> bytes:
    """A compiled book whose entries (word, start, length) have the form word + s, by an edit program."""
    parts = [text[i : i + block] for i in range(0, len(text), block)]
    texts = [pack_palmdoc(p) if compression == 2 else p for p in parts]
    tagx = [(1, 1, 1, 0), (2, 1, 2, 0), (42, 1, 4, 0), (0, 0, 0, 1)] if forms else [(1, 1, 1, 0), (2, 1, 2, 0), (0, 0, 0, 1)]
    orth = index([row(w.encode(), b"\x07" if forms else b"\x03", s, n, *([0] if forms else [])) for w, s, n in entries], tagx)
    infl = index([row(b"", b"\x03", 0, 1), row(b"\x02s", b"\x00")], [(5, 1, 1, 0), (26, 1, 2, 0), (0, 0, 0, 1)], [vint(6) + b"plural"]) if forms else []
    first = 1 + len(texts)
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHHH", head, 0, compression, 0, len(text), len(texts), block, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, 232)
    struct.pack_into(">I", head, 28, 65001)
    struct.pack_into(">III", head, 36, 6, first, first + len(orth) if forms else NONE)
    for p in range(48, 80, 4):
        struct.pack_into(">I", head, p, NONE)
    struct.pack_into(">II", head, 84, len(head), len(title.encode()))
    struct.pack_into(">II", head, 108, first + len(orth) + len(infl) if images else NONE, NONE)
    records = [bytes(head) + title.encode(), *texts, *orth, *infl, *images]
    out = bytearray(78)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(records))
    at = 78 + 8 * len(records)
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(records)
