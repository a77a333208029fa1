"""Source packages as tables: files, pages, definitions, headwords, forms, anchors, references, manifest and spine."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import package_kernel as k
from glossa.operators.rejects import failures, missing, together

MAX_OUTPUT = 8 << 30
FILE = "book_id string, file string, content binary"
FACT = "book_id string, file string, seq long, kind string, start long, `end` long, name string, value string, entry long, orth long, target string, anchor string"
PAGE = "book_id string, file string, title string, body_start long, body_end long, tag_start long, tag_end long, head_end long"


def _record(rows, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n.strip("`"), kinds[t]) for n, t in (c.split() for c in schema.split(", "))]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def files(archives: DataFrame, budget: int = MAX_OUTPUT) -> DataFrame:
    """(book_id, file, content) of archives (content); a file of one archive is a row, so pages are scanned in parallel."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                book = hashlib.sha256(data).hexdigest()
                yield _record([(book, name, content) for name, content in k.members(data, budget).items()], FILE)

    return archives.select("content").mapInArrow(run, FILE)


def _pages(package: DataFrame) -> DataFrame:
    return package.where(F.col("file").rlike(r"(?i)\.(xhtml|html|htm)$")).select("book_id", "file", "content")


def pages(package: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield _record([(b, f, *k.page(f, c)[0].values()) for b, f, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)], PAGE)

    return _pages(package).mapInArrow(run, PAGE)


def facts(package: DataFrame) -> DataFrame:
    """All that the pages say; ``entry`` and ``orth`` count from 0 within each page."""

    def run(batches):
        for batch in batches:
            rows = []
            for b, f, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows += [(b, f, n, x.kind, x.start, x.end, x.name, x.value, x.entry, x.orth, x.target, x.anchor) for n, x in enumerate(k.page(f, c)[1])]
            yield _record(rows, FACT)

    return _pages(package).mapInArrow(run, FACT)


def numbered(found: DataFrame, kind: str, local: str) -> DataFrame:
    """The facts of a kind with ``id``, their number in the book: pages in path order, then position."""
    order = Window.partitionBy("book_id").orderBy(F.col("file"), F.col(local))
    return found.where(F.col("kind") == kind).withColumn("id", (F.row_number().over(order) - 1).cast("long"))


def book(package: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of packages: page, definition, orth, form, anchor, reference."""
    found = facts(package)
    definition = numbered(found, "definition", "entry").select("book_id", "file", "id", "entry", "start", "end", F.col("value").alias("ancestors"))
    at = ["book_id", "file", "entry"]
    orth = numbered(found, "orth", "orth").select(*at, "orth", "id", "value", "start", "end").join(definition.select(*at, F.col("id").alias("entry_id")), at)
    form = numbered(found, "form", "seq").select(*at, "orth", "id", "name", "value", F.col("start").alias("position")).join(orth.select(*at, "orth", "entry_id", F.col("id").alias("orth_id")), [*at, "orth"])
    anchor = found.where("kind = 'anchor'").select(*at, "name", F.col("start").alias("position")).join(definition.select(*at, F.col("id").alias("entry_id")), at, "left")
    reference = found.where("kind IN ('link', 'image', 'stylesheet')").select("book_id", "file", "seq", "kind", F.col("value").alias("url"), "target", "anchor")
    order = Window.partitionBy("book_id").orderBy("file")
    page = pages(package).withColumn("page_id", (F.row_number().over(order) - 1).cast("long"))
    return {"page": page, "definition": definition, "orth": orth, "form": form, "anchor": anchor, "reference": reference}


def spine(package: DataFrame) -> DataFrame:
    """(book_id, file, pos, title): the reading order by the one package file, then other pages by path."""
    schema = "book_id string, file string, pos long, title string"

    def run(batches):
        for batch in batches:
            rows = []
            for b, f, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got = k.package(f, c)
                rows += [(b, got["manifest"][i][0], n, got["title"]) for n, i in enumerate(got["spine"])]
            yield _record(rows, schema)

    listed = package.where(F.col("file").rlike(r"(?i)\.opf$")).select("book_id", "file", "content").mapInArrow(run, schema)
    rest = _pages(package).select("book_id", "file").join(listed.select("book_id", "file"), ["book_id", "file"], "left_anti")
    n = Window.partitionBy("book_id").orderBy("late", "pos", "file")
    both = listed.withColumn("late", F.lit(0)).unionByName(rest.select("book_id", "file", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("late")))
    return both.withColumn("pos", (F.row_number().over(n) - 1).cast("long")).drop("late")


def reference_failures(package: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Links, images and stylesheets whose file or anchor is not in the package, and anchors that repeat."""
    refs = tables["reference"].where("target IS NOT NULL")
    have = package.select("book_id", F.col("file").alias("target"))
    anchors = tables["anchor"].select("book_id", F.col("file").alias("target"), F.col("name").alias("anchor"))
    twice = tables["anchor"].groupBy("book_id", "file", "name").agg(F.count_distinct("position").alias("n"))
    return together(
        missing(refs, have, ["book_id", "target"], "file", "url"),
        missing(refs.where("anchor IS NOT NULL AND kind = 'link'"), anchors, ["book_id", "target", "anchor"], "anchor", "url"),
        failures(refs.where("kind = 'image'"), "image", F.col("url"), ~F.col("target").rlike(r"(?i)\.(png|jpe?g|gif|bmp)$"), "UNSUPPORTED", "not a raster image"),
        failures(twice, "anchor", F.col("name"), F.col("n") > 1, "MALFORMED", "anchor at several positions"),
    )


def catalog_items(package: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(items, aliases) of packages: each headword's definition as payload, forms as aliases; headwords of one definition share it."""
    content = package.select("book_id", "file", "content")
    body = tables["definition"].join(content, ["book_id", "file"]).select("book_id", F.col("id").alias("entry_id"), F.expr("substring(content, cast(start + 1 AS int), cast(`end` - start AS int))").alias("payload"))
    items = tables["orth"].select("book_id", "id", F.col("value").alias("word"), "entry_id").join(body, ["book_id", "entry_id"]).select("book_id", "id", "word", "payload")
    return items, tables["form"].select("book_id", F.col("orth_id").alias("target_id"), F.col("value").alias("word"))
