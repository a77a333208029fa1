"""The indexed dictionary format, read independently of how it was written."""

from __future__ import annotations

import struct
from typing import NamedTuple

MAGIC = "StarDict's dict ifo file"


class FormatError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Parsed(NamedTuple):
    info: dict[str, str]
    entries: list[tuple[str, int, int]]
    synonyms: list[tuple[str, int]]
    bits: int


def order(word: str) -> tuple[bytes, bytes]:
    raw = word.encode()
    return raw.lower(), raw


def _words(data: bytes, tail: int, name: str):
    """(word, the ``tail`` bytes after its NUL) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\0", at)
        if end < 0 or end + 1 + tail > len(data):
            raise FormatError("MALFORMED", f"truncated {name}")
        word = data[at:end]
        if not 0 < len(word) < 256:
            raise FormatError("MALFORMED", f"key of {len(word)} bytes in {name}")
        try:
            yield word.decode(), data[end + 1 : end + 1 + tail]
        except UnicodeDecodeError as e:
            raise FormatError("MALFORMED", f"key in {name} is no UTF-8") from e
        at = end + 1 + tail


def info(text: bytes) -> dict[str, str]:
    lines = text.decode().splitlines()
    if not lines or lines[0] != MAGIC:
        raise FormatError("MALFORMED", "no dictionary header")
    fields = dict(x.split("=", 1) for x in lines[1:] if "=" in x)
    if fields.get("version") != "3.0.0" or fields.get("sametypesequence") != "h":
        raise FormatError("UNSUPPORTED", "version or content type")
    return fields


def parse(ifo: bytes, idx: bytes, syn: bytes, dict_bytes: int) -> Parsed:
    """Entries and synonyms; counts, sort order, targets and the tiling of payloads are checked."""
    fields = info(ifo)
    bits = int(fields.get("idxoffsetbits", "32"))
    if bits not in (32, 64):
        raise FormatError("UNSUPPORTED", f"{bits}-bit offsets")
    form = ">II" if bits == 32 else ">QI"
    entries = [(w, *struct.unpack(form, tail)) for w, tail in _words(idx, struct.calcsize(form), "idx")]
    synonyms = [(w, *struct.unpack(">I", tail)) for w, tail in _words(syn, 4, "syn")]
    if int(fields.get("wordcount", -1)) != len(entries) or int(fields.get("synwordcount", "0")) != len(synonyms) or int(fields.get("idxfilesize", -1)) != len(idx):
        raise FormatError("INCOMPLETE", "counts do not match the header")
    for rows, key in ((entries, lambda r: order(r[0])), (synonyms, lambda r: (*order(r[0]), r[1]))):
        if any(key(a) > key(b) for a, b in zip(rows, rows[1:], strict=False)):
            raise FormatError("MALFORMED", "rows are out of order")
    if any(t >= len(entries) for _, t in synonyms):
        raise FormatError("MALFORMED", "synonym without an entry")
    at = 0
    for offset, size in sorted({(o, n) for _, o, n in entries}):
        if offset != at or size == 0:
            raise FormatError("INCOMPLETE", "payloads overlap or leave a gap")
        at += size
    if at != dict_bytes:
        raise FormatError("INCOMPLETE", "payloads do not cover the dictionary")
    return Parsed(fields, entries, synonyms, bits)


def payload(data: bytes, offset: int, size: int) -> str:
    part = data[offset : offset + size]
    if len(part) != size or b"\0" in part:
        raise FormatError("MALFORMED", "payload")
    return part.decode()


def index_record(word: str, offset: int, size: int, bits: int = 32) -> bytes:
    return word.encode() + b"\0" + struct.pack(">II" if bits == 32 else ">QI", offset, size)


def synonym_record(word: str, target: int) -> bytes:
    return word.encode() + b"\0" + struct.pack(">I", target)
