"""The façade: inspect, convert, verify and look up books; what the command line calls."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.words import title_or_label
from glossa.operators import catalog, lookup, render
from glossa.operators.rejects import CheckFailed
from glossa.runtime import stage
from glossa.sources import books, packages, stardict


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """A row for each book file: size, header facts and why it would be refused."""
    files, _ = books.read_files(spark, path)
    return books.scan(files, "books")


def compiled_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of compiled books, staged, so that each file is parsed once for each table."""
    return {what: stage(books.scan(files, what), what) for what in ("books", "texts", "entries", "aliases", "resources", "errors")}


def compiled_items(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(items, aliases): each entry with the bytes of its text, supplements included, and forms and generated keys.

    Links by position or anchor lead to the generated key of the entry that
    owns their target; images are named by their files. A link or an image
    without a target, or one at odds with another, raises ``CheckFailed``.
    """
    entries = stage(books.with_supplements(tables["entries"], tables["texts"]), "entries")
    names = tables["books"].select("book_id", F.col("book_id").alias("namespace"))
    edits, bad = render.plan(tables["texts"], entries, tables["resources"], names, sources=True)
    refuse(bad)
    edits = stage(edits, "edits")
    bare = names.select("book_id", F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    payloads = render.definitions(entries.select("book_id", "id", "start", "end"), tables["texts"], edits, bare)
    items = entries.select("book_id", "id", F.col("headword").alias("word")).join(payloads, ["book_id", "id"])
    forms = tables["aliases"].select("book_id", "word", F.col("id").alias("target_id"))
    return items, forms.unionByName(render.keys(entries, edits, names))


def refuse(bad: DataFrame) -> None:
    """Raises the first of the failures of a check, if there is one."""
    for r in bad.limit(1).collect():
        raise CheckFailed(r.code, f"{r.check} {r.key}")


def _from_packages(archives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, aliases, titles) of source packages."""
    package = stage(packages.files(archives), "package")
    tables = packages.book(package)
    refuse(packages.reference_failures(package, tables))
    return *packages.catalog_items(package, tables), packages.spine(package).groupBy("book_id").agg(F.max("title").alias("title"))


def _from_compiled(files: DataFrame, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, aliases, titles) of compiled books; their images are written below ``out``."""
    tables = compiled_tables(files)
    for r in tables["errors"].limit(1).collect():
        raise CheckFailed(r.code, r.message)
    made = compiled_items(tables)
    stardict.write_resources(tables["resources"].select("book_id", "file", "content"), out)
    return *made, tables["books"].select("book_id", "title")


def convert(spark: SparkSession, path: str, out: str, backend: str = "auto") -> DataFrame:
    """Write a dictionary for each book below ``path`` and read it back; a row for each book with its counts.

    ``auto`` takes each file by itself: an archive (.zip, .epub), or a compiled
    book that holds one, as a source package, and other files as compiled books;
    ``srcs`` refuses files without a package, and ``compiled`` reads no package.
    A failed check raises ``CheckFailed``.
    """
    files, refused = books.read_files(spark, path)
    if refused.limit(1).count():
        raise CheckFailed("LIMIT", "an input file is too large")
    parts, plain = [], files
    if backend != "compiled":
        held = stage(books.archives(files), "archives")
        bare = held.where("archive IS NULL").select("path")
        if backend == "srcs" and bare.limit(1).count():
            raise CheckFailed("INCOMPLETE", f"{bare.first().path} holds no source package")
        plain = files.join(bare, "path", "left_semi")
        if held.where("archive IS NOT NULL").limit(1).count():
            parts.append(_from_packages(held.where("archive IS NOT NULL").select(F.col("archive").alias("content"))))
    if not parts or plain.limit(1).count():
        parts.append(_from_compiled(plain, out))
    items, aliases, titles = (reduce(DataFrame.unionByName, p) for p in zip(*parts, strict=True))
    items = stage(items, "items")
    written = stage(stardict.write(items, aliases, out, titles.withColumn("title", title_or_label(F.col("title"), F.lit("en")))), "written")
    wrong = verify(spark, out, items).limit(1).collect()
    if wrong:
        raise CheckFailed("VERIFY", f"{wrong[0].word!r} was not read back as written")
    return written


def verify(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """Differences between items and the dictionaries of a folder; reading checks the format itself."""
    return stardict.read_back(spark, folder, items)


def open_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, keys) of the dictionaries of a folder, for lookups; with several books, ordinals are theirs."""
    entries, synonyms = stardict.read(spark, folder)
    return entries, catalog.keys(entries, synonyms)


def look_up(spark: SparkSession, folder: str, words: list[str], app: str = "exact") -> DataFrame:
    """Hits of the words in each book, by the rules of a reader, or byte for byte."""
    entries, keys = open_index(spark, folder)
    asked = spark.createDataFrame([(w,) for w in words], "query string")
    if app == "exact":
        return lookup.exact(asked, keys).join(entries, ["book_id", "ordinal"]).select("book_id", "query", "ordinal", "word")
    return lookup.search(asked, keys, entries).where(F.col("app") == app).join(entries.select("book_id", "ordinal", "word"), ["book_id", "ordinal"])


def main(args: list[str] | None = None) -> int:
    """inspect PATH | convert PATH OUT [--backend] | lookup FOLDER WORD... [--app]; exit status by kind of failure."""
    p = argparse.ArgumentParser(prog="glossa", description=main.__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("inspect")
    a.add_argument("path")
    a = sub.add_parser("convert")
    a.add_argument("path")
    a.add_argument("out")
    a.add_argument("--backend", choices=["auto", "compiled", "srcs"], default="auto")
    a = sub.add_parser("lookup")
    a.add_argument("folder")
    a.add_argument("words", nargs="+")
    a.add_argument("--app", default="exact")
    got = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        if got.verb == "inspect":
            rows = inspect(spark, got.path)
        elif got.verb == "convert":
            rows = convert(spark, got.path, got.out, got.backend)
        else:
            rows = look_up(spark, got.folder, got.words, got.app)
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))
    except CheckFailed as e:
        print(e, file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
