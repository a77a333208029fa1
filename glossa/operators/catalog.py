"""The indexed dictionary: payload ranges, ordinals, aliases, and the bytes of the index files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.words import ascii_lower, order_key
from glossa.operators.intervals import ordinals, prefix_sum
from glossa.operators.lookup import books


def payload_ranges(items: DataFrame, payload: str = "payload", order: str = "id") -> DataFrame:
    """(sha, offset, size): each distinct payload once, laid end to end in the order of its first item.

    Equal payloads share a range; only digests and sizes are shuffled.
    """
    data = F.col(payload).cast("binary")
    return digest_ranges(items.select(F.sha2(data, 256).alias("sha"), F.octet_length(data).cast("long").alias("size"), order), order)


def digest_ranges(rows: DataFrame, order: str = "id") -> DataFrame:
    """``payload_ranges`` of rows (sha, size, id) whose digests are at hand."""
    first = rows.groupBy("sha").agg(F.min(order).alias("first"), F.max("size").alias("size"))
    return prefix_sum(first, [F.col("first")], "size").select("sha", "offset", "size")


def catalog(items: DataFrame) -> DataFrame:
    """(ordinal, word, id) of items (id, word) in dictionary order; ties by id. With a ``book_id``, each book counts from 0.

    Books are laid end to end in one global order, and each book's first
    position is taken off, so a book of any size costs no single task.
    """
    of = books(items)
    rows = ordinals(items.select(*of, "id", "word"), [*map(F.col, of), *order_key(F.col("word")), F.col("id")])
    if of:
        first = rows.groupBy(*of).agg(F.min("ordinal").alias("__first"))
        rows = rows.join(first, of).withColumn("ordinal", F.col("ordinal") - F.col("__first"))
    return rows.select(*of, "ordinal", "word", "id")


def synonyms(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(word, target): aliases (word, target_id) with the ordinals of their targets, a multiset."""
    of = [c for c in books(entries) if c in aliases.columns]
    return aliases.join(entries.select(*of, F.col("id").alias("target_id"), F.col("ordinal").alias("target")), [*of, "target_id"]).select(*of, "word", "target")


def dangling(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases whose target is no entry."""
    return aliases.join(entries.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def index_records(entries: DataFrame, bits: int = 32) -> DataFrame:
    """Adds ``record``: word, NUL, big-endian offset and size."""
    width = bits // 4
    number = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    return entries.withColumn("record", F.concat(F.encode("word", "utf-8"), F.unhex(F.lit("00")), number(F.col("offset"), width), number(F.col("size"), 8)))


def synonym_records(rows: DataFrame) -> DataFrame:
    """Adds ``record``: word, NUL, big-endian ordinal of the target."""
    return rows.withColumn("record", F.concat(F.encode("word", "utf-8"), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex("target"), 8, "0"))))


def synonym_order(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the 0-based position by word order, then target."""
    return ordinals(rows, [*order_key(F.col("word")), F.col("target")], "pos")


def info(bookname: str, entries: int, synonyms: int, index_bytes: int, bits: int = 32) -> str:
    """The text of the header file."""
    lines = ["StarDict's dict ifo file", "version=3.0.0", f"bookname={bookname}", f"wordcount={entries}"]
    lines += [f"synwordcount={synonyms}"] * (synonyms > 0) + [f"idxfilesize={index_bytes}"] + [f"idxoffsetbits={bits}"] * (bits != 32) + ["sametypesequence=h"]
    return "\n".join(lines) + "\n"


def keys(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, ordinal, kind, pos) of all that can be looked up: headwords (0) and synonyms (1)."""
    of = books(entries)
    a = entries.select(*of, F.col("word").alias("key"), "ordinal", F.lit(0).alias("kind"), F.col("ordinal").alias("pos"))
    b = rows.select(*of, F.col("word").alias("key"), F.col("target").alias("ordinal"), F.lit(1).alias("kind"), F.col("pos") if "pos" in rows.columns else F.col("target").alias("pos"))
    return a.unionByName(b)


def folded_ascii(entries: DataFrame) -> DataFrame:
    return entries.withColumn("ascii", ascii_lower(F.col("word")))
