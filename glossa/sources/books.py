"""Compiled books as tables: container records, header, gate, text, entries, aliases, resources and record roles.

``read_files`` drops files over a size limit by their listing, before their
content is read. Every table has ``book_id``, the SHA-256 of the file, first;
a book is one row of work and never more than its own bytes in memory. A book
that fails gives one row in ``errors`` and none elsewhere.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import book_kernel as k

MAX_INPUT, MAX_TEXT, MAX_ENTRIES, MAX_ALIASES, MAX_OPERATIONS = 1 << 30, 512 << 20, 2_000_000, 8_000_000, 100_000_000
COMPRESSIONS = (1, 2, 17480)


def read_files(spark: SparkSession, path: str, limit: int = MAX_INPUT) -> tuple[DataFrame, DataFrame]:
    """(files (path, content), refused (path, length)): the limit is checked on the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= limit).select("path", "content"), files.where(F.col("length") > limit).select("path", "length")


def records(data: bytes) -> list[tuple[int, int]]:
    """Spans of the container's records."""
    if k.cut(data, 60, 8) != b"BOOKMOBI":
        raise k.BookError("UNSUPPORTED", "not a book container")
    if k.u16(data, 32) & 1 or k.u32(data, 72):
        raise k.BookError("UNSUPPORTED", "resource database or chained record list")
    n = k.u16(data, 76)
    if n == 0:
        raise k.BookError("MALFORMED", "no records")
    starts = [k.u32(data, 78 + 8 * i) for i in range(n)]
    ends = [*starts[1:], len(data)]
    if starts[0] < 78 + 8 * n or any(a >= b for a, b in zip(starts, ends, strict=True)):
        raise k.BookError("MALFORMED", "record offsets")
    return list(zip(starts, ends, strict=True))


class Header(NamedTuple):
    compression: int
    text_length: int
    text_records: int
    encryption: int
    version: int
    encoding: int
    orth: int | None
    infl: int | None
    extra: list[int]
    first_image: int | None
    huff: int | None
    huff_count: int
    trailers: int
    hybrid: bool
    title: str
    authors: list[str]
    languages: tuple[int, int]
    exth: list[tuple[int, str]]


def header(r: bytes) -> Header:
    """Fields of the first record; the metadata list has authors (100) and a title (503)."""
    if k.cut(r, 16, 4) != b"MOBI":
        raise k.BookError("UNSUPPORTED", "no book header")
    size = k.u32(r, 20)
    end = 16 + size
    if size < 116 or end > len(r):
        raise k.BookError("UNSUPPORTED", "short header")
    opt = lambda at: None if k.u32(r, at) == k.NONE else k.u32(r, at)
    encoding = k.u32(r, 28)
    title, authors, exth, hybrid = k.decode(k.cut(r, k.u32(r, 84), k.u32(r, 88)), encoding), [], [], False
    if end >= 132 and k.u32(r, 128) & 0x40:
        if k.cut(r, end, 4) != b"EXTH":
            raise k.BookError("MALFORMED", "metadata list is missing")
        block = k.cut(r, end, k.u32(r, end + 4))
        at = 12
        for _ in range(k.u32(block, 8)):
            kind, n = k.u32(block, at), k.u32(block, at + 4)
            if n < 8:
                raise k.BookError("MALFORMED", "metadata record")
            value = k.cut(block, at + 8, n - 8)
            exth.append((kind, value.hex()))
            if kind == 100:
                authors.append(k.decode(value, encoding))
            elif kind == 503:
                title = k.decode(value, encoding)
            elif kind == 121 and len(value) == 4 and k.u32(value, 0) != k.NONE:
                hybrid = True
            at += n
        if any(block[at:]):
            raise k.BookError("MALFORMED", "bytes after the metadata list")
    return Header(
        k.u16(r, 0), k.u32(r, 4), k.u16(r, 8), k.u16(r, 12), k.u32(r, 36), encoding, opt(40), opt(44), [n for p in range(48, 77, 4) if (n := opt(p)) is not None],
        opt(108), opt(112), k.u32(r, 116), k.u16(r, 242) if end >= 244 else 0, hybrid, title, authors, (k.u32(r, 96), k.u32(r, 100)), exth,
    )


def gate(h: Header, convert: bool = True) -> str | None:
    """Why a book cannot be read, by the first rule that it breaks."""
    rules = (
        (h.encryption != 0, "encrypted"),
        (h.hybrid or h.version >= 8, "newer or hybrid format"),
        (h.version < 5, f"version {h.version}"),
        (h.orth is None, "no headword index"),
        (h.compression not in COMPRESSIONS, f"compression {h.compression}"),
        (convert and bool(h.extra), "additional indexes"),
    )
    return next((why for bad, why in rules if bad), None)


def text(data: list[bytes], h: Header) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """The decoded text, and (record, decoded, compressed, trailer bytes) of each text record."""
    if h.text_length > MAX_TEXT or not 0 < h.text_records < len(data):
        raise k.BookError("LIMIT", "text size or records")
    budget, huff = [MAX_OPERATIONS], None
    if h.compression == 17480:
        if h.huff is None or h.huff_count < 2 or h.huff + h.huff_count > len(data):
            raise k.BookError("MALFORMED", "code records")
        huff = k.Huff(data[h.huff], data[h.huff + 1 : h.huff + h.huff_count])
    parts, audit, left = [], [], h.text_length
    for n in range(1, h.text_records + 1):
        raw = k.strip_trailers(data[n], h.trailers)
        part = raw if h.compression == 1 else k.palmdoc(raw, left) if h.compression == 2 else huff.decompress(raw, left, budget)
        left -= len(part)
        if left < 0:
            raise k.BookError("INCOMPLETE", "text exceeds its declaration")
        parts.append(part)
        audit.append((n, len(part), len(raw), len(data[n]) - len(raw)))
    if left:
        raise k.BookError("INCOMPLETE", "text is shorter than declared")
    out = b"".join(parts)
    k.decode(out, h.encoding)
    return out, audit


def entries(data: list[bytes], h: Header, size: int) -> tuple[list[dict], list[dict]]:
    """Headwords with their spans, then the gaps as supplements; and all forms. A length of 0 is that of the one entry at the same start."""
    orth = k.Index(data, h.orth)
    orth.require(1, 2, 42)
    if not orth.rows:
        raise k.BookError("INCOMPLETE", "no headwords")
    infl = k.Index(data, h.infl) if h.infl is not None else None
    new = orth.has(42)
    if new and infl is None and any(42 in r.tags for r in orth.rows):
        raise k.BookError("INCOMPLETE", "no inflection index")
    old = k.old_suffixes(infl) if infl and not new else None
    longest = max(map(len, old), default=0) if old else 0
    known: dict[int, set[int]] = {}
    for row in orth.rows:
        if n := k.scalar(row, 2):
            known.setdefault(k.scalar(row, 1), set()).add(n)
    out, forms = [], []
    for i, row in enumerate(orth.rows):
        start, n = k.scalar(row, 1), k.scalar(row, 2)
        if n == 0:
            if len(known.get(start, ())) != 1:
                raise k.BookError("INCOMPLETE", "no entry for a length of 0")
            (n,) = known[start]
        if start + n > size:
            raise k.BookError("MALFORMED", "entry beyond the text")
        out.append({"id": i, "headword": orth.text(row.label), "start": start, "end": start + n, "kind": "headword"})
        made = [(k.decode(w, orth.encoding), None) for w in k.old_aliases(row.label, old, longest)] if old is not None else [(k.decode(w, orth.encoding), g) for w, g in k.new_aliases(row, infl)] if infl else []
        forms += [{"id": i, "seq": j, "word": w, "group_name": g} for j, (w, g) in enumerate(made)]
        if len(forms) > MAX_ALIASES:
            raise k.BookError("LIMIT", "forms")
    return out, forms


ROLES = ("header", "text", "orth_index", "infl_index", "code_table", "image", "source_archive", "other")


def roles(data: list[bytes], h: Header) -> list[str]:
    """What each record is for."""
    out = []
    for n, r in enumerate(data):
        image = h.first_image is not None and n >= h.first_image and k_image(r)
        claims = [
            n == 0, 0 < n <= h.text_records, h.orth is not None and n == h.orth, h.infl is not None and n == h.infl,
            h.compression == 17480 and h.huff is not None and h.huff <= n < h.huff + h.huff_count, bool(image), r[:4] == b"SRCS",
        ]
        out.append(next((role for role, hit in zip(ROLES, claims, strict=False) if hit), "other"))
    return out


def k_image(data: bytes) -> tuple[str, str] | None:
    from glossa.functions.words import IMAGES

    return next(((ext, media) for magic, ext, media in IMAGES if data.startswith(bytes.fromhex(magic))), None)


def source_archive(data: list[bytes]) -> tuple[int, bytes] | None:
    """(record, archive) of the one embedded source package."""
    found = [(n, r[r.find(b"PK\x03\x04") :]) for n, r in enumerate(data) if r[:4] == b"SRCS" and 0 <= r.find(b"PK\x03\x04") <= 64]
    if len(found) > 1:
        raise k.BookError("UNSUPPORTED", "several source packages")
    return found[0] if found else None


def archives(files: DataFrame) -> DataFrame:
    """(path, archive) of files (path, content): an archive itself, or the source package that a compiled book holds, else null.

    Files that are no books have none; what is wrong with them is found when they are scanned.
    """

    def one(content: bytes) -> bytes | None:
        if content[:4] == b"PK\x03\x04":
            return content
        try:
            found = source_archive([content[a:b] for a, b in records(content)])
        except k.BookError:
            return None
        return found[1] if found else None

    def run(batches):
        for batch in batches:
            held = [one(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["path", "archive"])

    return files.select("path", "content").mapInArrow(run, "path string, archive binary")


SCHEMAS = {
    "books": "title string, authors array<string>, version long, compression long, encoding long, records long, text_bytes long, refused string",
    "records": "record long, start long, end long, role string, sha256 string",
    "texts": "text binary",
    "text_records": "record long, decoded_bytes long, compressed_bytes long, trailer_bytes long",
    "entries": "id long, headword string, start long, end long, kind string",
    "aliases": "id long, seq long, word string, group_name string",
    "resources": "recindex long, record long, file string, media_type string, content binary",
    "errors": "code string, message string",
}


def _facts(data: bytes, what: str) -> list[tuple]:
    spans = records(data)
    parts = [data[a:b] for a, b in spans]
    h = header(parts[0])
    if what == "books":
        return [(h.title, h.authors, h.version, h.compression, h.encoding, len(parts), h.text_length, gate(h))]
    if what == "records":
        return [(n, a, b, role, hashlib.sha256(parts[n]).hexdigest()) for n, ((a, b), role) in enumerate(zip(spans, roles(parts, h), strict=True))]
    if why := gate(h):
        raise k.BookError("UNSUPPORTED", why)
    if what == "resources":
        out = []
        for n in range(h.first_image, len(parts)) if h.first_image is not None else ():
            if parts[n][:4] in (b"FONT", b"AUDI", b"VIDE"):
                raise k.BookError("UNSUPPORTED", "font, audio or video")
            if kind := k_image(parts[n]):
                i = n - h.first_image + 1
                out.append((i, n, f"image-{i:06d}.{kind[0]}", kind[1], parts[n]))
        return out
    body, audit = text(parts, h)
    if what == "texts":
        return [(body,)]
    if what == "text_records":
        return audit
    rows, forms = entries(parts, h, len(body))
    return [tuple(r.values()) for r in (rows if what == "entries" else forms)]


def scan(files: DataFrame, what: str) -> DataFrame:
    """One of the tables of ``SCHEMAS`` for books (path, content)."""
    schema = f"book_id string, {SCHEMAS[what]}".replace(", end long", ", `end` long")
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for content in batch.column(0).to_pylist():
                book = hashlib.sha256(content).hexdigest()
                try:
                    if what == "errors":
                        for x in ("books", "entries", "resources"):
                            _facts(content, x)
                        continue
                    out += [(book, *r) for r in _facts(content, what)]
                except k.BookError as e:
                    if what == "errors":
                        out.append((book, e.code, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_arrow(schema))

    return files.select("content").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n.strip("`"), kinds[t]) for n, t in (c.split() for c in schema.split(", "))])


def with_supplements(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries and, after them, a supplement for each gap that they leave of the text."""
    from glossa.functions.words import label
    from glossa.operators.intervals import gaps, numbered

    bounds = texts.select("book_id", F.octet_length("text").cast("long").alias("bound"))
    holes = numbered(gaps(found.select("book_id", "start", "end"), bounds, "book_id"), ["book_id"], [F.col("start")], "n")
    sizes = found.groupBy("book_id").agg(F.count(F.lit(1)).alias("have"))
    extra = holes.join(sizes, "book_id").select("book_id", (F.col("have") + F.col("n")).alias("id"), label(F.lit("en"), "supplement", F.col("n") + 1).alias("headword"), "start", "end", F.lit("supplement").alias("kind"))
    return found.unionByName(extra)
