"""WARC archives compressed with a dictionary of their own.

Pages are written in archives of about ``ARCHIVE`` bytes of records. A
Zstandard dictionary, built from all of an archive's records, lies in a leading
skippable frame; each record, the leading ``warcinfo`` too, is compressed as a
frame of its own, so a record can be read by its offset. Records with equal
payloads of at least ``MIN_REVISIT`` bytes are stored once, as the response
with the largest id; the others revisit it.

Which payloads occur more than once is found from digests alone. A bitmap of
those digests, of a fixed size, tells which rows may have a copy elsewhere;
only these rows meet their response's id in a join, every other page is written
where it is read.

Archives are written into the shared folder under names that follow from the
partition's number and the attempt at it; those of attempts that did not end
well are deleted, so a task that runs again leaves its own files only. ``read`` takes the archives back with Spark's
binary file reader, finds each frame's end from its block headers, verifies
each payload's digest and returns a row for each record.

Defined cases: null html is an empty payload; a null id is written as an
absent header and read back as null; a null url is the target ``NO_URL`` and
read back as null; rows with the same id and equal payloads are responses
alike, with record ids of their own; an archive with too few records for a
dictionary has an empty one; payloads of any length are stored whole; an empty
table gives no rows; other columns are ignored. No page has a time, so all
records bear the ``date`` that the caller gives.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.runtime import shared_dir, stage, unstage

MIN_REVISIT = 1000
#: The magic number of the leading skippable frame.
SKIPPABLE = 0x184D2A5D
LEVEL, DICTIONARY = 3, 64 << 10
#: Records of an archive are held until they have these bytes; the dictionary learns from all of them.
ARCHIVE = 32 << 20
DATE = "2000-01-01T00:00:00Z"
NO_URL = "urn:x-no-url:"
SPLIT = b"\r\n\r\n"


def _head(kind: str, ident: str, fields: list[tuple[str, object]], block: bytes, date: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ident)}>", f"WARC-Date: {date}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines + [f"{k}: {v}" for k, v in fields]).encode() + SPLIT + block + SPLIT


def info(ident: str, date: str = DATE) -> bytes:
    """The record that begins an archive."""
    return _head("warcinfo", f"{ident}:info", [("Content-Type", "application/warc-fields"), ("WARC-Filename", ident)], b"software: glossa\r\nformat: WARC File Format 1.1\r\n", date)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None, ident: str | None = None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit that names the response. ``ident`` tells it from all others."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + SPLIT
    target = lambda u: NO_URL if u is None else quote(u, safe=":/?#[]@!$&()*+,;=%")
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", page_id))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", target(refers_url)), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-ID", refers_to)]
    return _head("revisit" if revisit else "response", ident or f"{page_id}:{url}:{digest}", fields, http if revisit else http + payload, date)


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary built from the records; empty if they are too few or too alike to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, steps=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(held: list[bytes]) -> bytes:
    """An archive of the records."""
    words = dictionary(held)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(words) if words else b""
    used = zstandard.ZstdCompressionDict(words) if words else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=used, write_content_size=True, write_checksum=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(press, held)])


class Writer:
    """Gathers the records of one archive, which is written when it is closed."""

    def __init__(self, sink):
        self.sink, self.held, self.size = sink, [], 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)

    def close(self) -> None:
        self.sink.write(pack(self.held))


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from the sizes in its block headers."""
    checksum = data[at + 4] & 4
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        if kind == 3:
            raise ValueError("a reserved block type")
        at += 3 + (1 if kind == 1 else size)  # a run of one byte stores that byte only
    at += 4 if checksum else 0
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def records(data: bytes):
    """(offset, bytes) of each record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]) if n else b""
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        end = frame_end(view, at)
        yield at, expand.decompress(view[at:end])
        at = end


def parse(data: bytes) -> dict | None:
    """Headers and payload of one record, None for a ``warcinfo``; a response's payload is checked against its digest."""
    head, _, rest = data.partition(SPLIT)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block, kind = rest[: int(fields["Content-Length"])], fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(SPLIT)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("a payload does not match its digest")
    page, refers, url = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID"), fields["WARC-Target-URI"]
    return {"page_id": page and int(page), "url": None if url == NO_URL else unquote(url), "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers)}


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, refers_url): the largest id among equal payloads, where it is another's."""
    return _with_copies(pages)[0]


def _with_copies(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("size"))
    same = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "size")
    tops = stage(same.agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("top_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL").select(F.col("digest").alias("d"), F.col("size").alias("s"), "top", "top_url"), "copies")
    marked = tx.sifted(rows, "digest", tops, "d")
    maybe = F.col("__maybe") & (F.col("size") >= MIN_REVISIT)
    alone = marked.where(~maybe).select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    both = marked.where(maybe).hint("merge").join(tops, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return alone.unionByName(both.select("page_id", "url", "html", "digest", F.when(other, F.col("top")).cast("long").alias("refers_to"), F.when(other, F.col("top_url")).alias("refers_url"))), tops


def write(pages: DataFrame, folder: str, date: str = DATE, size: int | None = None) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record of an archive in ``folder``; archives have about ``size`` bytes of records."""
    limit = size or ARCHIVE
    rows, copies = _with_copies(pages.withColumn("page_id", F.col("page_id").cast("long")))
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration())
    store.mkdirs(path)
    qualified = store.makeQualified(path).toString()
    uri = "file://" + qualified[5:] if qualified.startswith("file:/") and not qualified.startswith("file://") else qualified

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        where, path = pyarrow.fs.FileSystem.from_uri(uri)
        out, number, n = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = Writer(where.open_output_stream(f"{path}/part-{part:06d}-{attempt}-{number:06d}.warc.zst", compression=None))
                    out.add(info(f"part-{part:06d}-{number:06d}", date))
                out.add(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], r["refers_url"], f"{part}:{n}:{r['page_id']}", date))
                n += 1
                if out.size >= limit:
                    out.close()
                    out.sink.close()
                    out, number = None, number + 1
        if out is not None:
            out.close()
            out.sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{attempt}-"], pa.string())], ["written"])

    written = {r.written for r in tx.arrow_map(rows, run, "written string").collect()}  # a row for each partition
    for f in store.listStatus(path):
        if f.getPath().getName().rpartition("-")[0] + "-" not in written:
            store.delete(f.getPath(), False)  # of an attempt that failed or lost a race
    unstage(copies)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in ``folder``; needs as much memory as one archive."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for at, x in records(data.as_py()):
                    if (r := parse(x)) is not None:
                        rows.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], at, len(x)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    return tx.arrow_map(files.select("content"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_bytes long")


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_offset", "record_bytes"]


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages into fresh archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder)
