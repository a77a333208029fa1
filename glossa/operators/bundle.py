"""What a finished book is checked and described by: invariants, routes, audits, reports, manifests, viewer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import words
from glossa.operators.intervals import covered_length, span_ok
from glossa.operators.multiset import difference
from glossa.operators.rejects import failures, together

MAX_ENTRY = 32 << 20


def document_failures(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Violations of a compiled book: ids, headwords, spans and the coverage of its text.

    ``entries`` (book_id, id, headword, start, end, kind), ``texts`` (book_id, text).
    """
    sized = texts.select("book_id", F.octet_length("text").cast("long").alias("bound"))
    placed = entries.join(sized, "book_id")
    twice = entries.groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("n"))
    covered = sized.join(covered_length(entries.select("book_id", "start", "end"), "book_id"), "book_id", "left")
    length = F.col("end") - F.col("start")
    return together(
        failures(twice, "entry id", F.concat_ws(":", "book_id", "id"), F.col("n") > 1, "MALFORMED", "id is not unique"),
        failures(entries, "headword", F.col("headword"), ~words.headword_ok(F.col("headword")), "MALFORMED", "not a headword"),
        failures(placed, "span", F.concat_ws(":", "book_id", "id"), ~span_ok(F.col("start"), F.col("end"), F.col("bound")) | (length < 1), "MALFORMED", "span is empty or outside the text"),
        failures(placed, "size", F.concat_ws(":", "book_id", "id"), length > MAX_ENTRY, "LIMIT", "entry is too large"),
        failures(covered, "coverage", F.col("book_id"), F.coalesce("length", F.lit(0)) < F.col("bound"), "INCOMPLETE", "text outside every entry"),
    )


def tag_failures(descriptors: DataFrame, allowed: list[int]) -> DataFrame:
    """Index descriptors (book_id, tags) that declare more than the allowed tags."""
    extra = F.array_except("tags", F.array(*[F.lit(t).cast("long") for t in allowed]))
    return failures(descriptors, "tag", F.col("book_id"), F.size(extra) > 0, "UNSUPPORTED", "unknown tag")


def style_attributes_ok(attrs: Column) -> Column:
    """Attributes (a map) that a style element may have: few names, CSS, all or screen media."""
    names = F.forall(F.map_keys(attrs), lambda n: n.isin("id", "class", "lang", "xml:lang", "dir", "nonce", "type", "media"))
    kind, media = F.lower(F.coalesce(attrs["type"], F.lit(""))), F.lower(F.coalesce(attrs["media"], F.lit("")))
    return names & kind.isin("", "text/css") & media.isin("", "all", "screen")


def text_ok(data: Column) -> Column:
    """Bytes that are UTF-8 without control characters but tab and line ends."""
    text = F.decode(data, "utf-8")
    return F.is_valid_utf8(data.cast("string")) & ~text.rlike(r"[\p{Cc}&&[^\t\n\r]]")


def budget_failures(files: DataFrame, limit: int) -> DataFrame:
    """Books (book_id) whose files' sizes (bytes) pass a limit together."""
    total = files.groupBy("book_id").agg(F.sum("bytes").alias("n"))
    return failures(total, "budget", F.col("book_id"), F.col("n") > limit, "LIMIT", "output size")


def collisions(generated: DataFrame, source: DataFrame, column: str = "word") -> DataFrame:
    """Generated keys that are words of the source too."""
    return failures(generated.join(source.select("book_id", column), ["book_id", column], "left_semi"), "generated key", F.col(column), F.lit(True), "INCOMPLETE", "collides with a source word")


def route_failures(routes: DataFrame, keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Routes (book_id, route, offset) that do not lead to exactly one entry at their offset.

    ``keys`` (book_id, key, ordinal), ``entries`` (book_id, ordinal, offset).
    """
    hits = routes.join(keys.withColumnRenamed("key", "route"), ["book_id", "route"], "left").join(entries.withColumnRenamed("offset", "at"), ["book_id", "ordinal"], "left")
    by = hits.groupBy("book_id", "route").agg(F.count_distinct("ordinal").alias("n"), F.bool_and(F.col("at").eqNullSafe(F.col("offset"))).alias("same"))
    return failures(by, "route", F.col("route"), (F.col("n") != 1) | ~F.col("same"), "VERIFY", "does not lead to its entry")


def mismatches(expected: DataFrame, actual: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that are missing, extra or differ, by a full outer join on ``key``."""
    a = expected.select(*key, F.struct(*columns).alias("want"))
    b = actual.select(*key, F.struct(*columns).alias("got"))
    return a.join(b, key, "full").where(~F.col("want").eqNullSafe(F.col("got")))


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files (path, content), to be listed by path."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_failures(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against a manifest."""
    return difference(listed.select("path", "bytes", "sha256"), found.select("path", "bytes", "sha256"), ["path", "bytes", "sha256"])


def stylesheet_files(books: DataFrame) -> DataFrame:
    """(book_id, path, css): the stylesheet of books (book_id, css, link) and its linked copy; none for empty CSS."""
    paths = F.when(F.coalesce("css", F.lit("")) == "", F.array().cast("array<string>")).when(F.col("link"), F.array(F.lit("dictionary.css"), F.lit("res/dictionary.css"))).otherwise(F.array(F.lit("dictionary.css")))
    return books.select("book_id", F.explode(paths).alias("path"), "css")


def gallery(images: DataFrame) -> DataFrame:
    """(book_id, html): a heading and a figure for each image (book_id, title, pos, label, path)."""
    figure = F.concat(F.lit('<figure><img src="'), words.escape_html(F.col("path")), F.lit('"/><figcaption>'), words.escape_html(F.col("label")), F.lit("</figcaption></figure>"))
    parts = images.groupBy("book_id").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("pos", figure.alias("f")))).alias("fs"))
    return parts.select("book_id", F.concat(F.lit("<h1>"), words.escape_html(F.col("title")), F.lit("</h1>"), F.array_join(F.transform("fs", lambda x: x.f), "")).alias("html"))


def article_audit(articles: DataFrame) -> DataFrame:
    """For each payload (kind, id, file, source, offset, prefix, fragment, suffix): digests and byte counts."""
    size = lambda c: F.octet_length(c).cast("long")
    whole = F.concat("prefix", "fragment", "suffix")
    return articles.select("kind", "id", "file", words.sha256(F.col("source")).alias("source_sha256"), "offset", size(whole).alias("size"), words.sha256(whole).alias("sha256"), size("prefix").alias("prefix_bytes"), size("fragment").alias("fragment_bytes"), size("suffix").alias("suffix_bytes"))


def report(entries: DataFrame, aliases: DataFrame, link_keys: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each book: headwords, aliases, supplements, output counts and covered bytes."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    e = entries.groupBy("book_id").agg(of("headword").alias("source_headwords"), of("supplement").alias("supplement_entries"), F.count(F.lit(1)).alias("output_entries"))
    a = aliases.groupBy("book_id").agg(F.count(F.lit(1)).alias("source_aliases"))
    k = link_keys.select("book_id", "key", "id").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("link_keys"))
    c = covered_length(entries.select("book_id", "start", "end"), "book_id").withColumnRenamed("length", "covered_bytes")
    out = e.join(a, "book_id", "left").join(k, "book_id", "left").join(c, "book_id", "left").join(texts.select("book_id", F.octet_length("text").cast("long").alias("text_bytes")), "book_id", "left")
    out = out.fillna(0, ["source_aliases", "link_keys", "covered_bytes"])
    return out.withColumn("output_synonyms", F.col("source_aliases") + F.col("output_entries") + F.col("link_keys"))


def viewer_rows(orths: DataFrame, forms: DataFrame) -> DataFrame:
    """(key, url, headword, entry_id) of headwords, then of their forms, for a static page's search."""
    url = F.concat(words.browser_path(F.col("file")), F.lit("#"), words.browser_anchor(F.col("entry_id")))
    a = orths.select(F.col("value").alias("key"), url.alias("url"), F.col("value").alias("headword"), "entry_id")
    heads = orths.select("book_id", F.col("id").alias("orth_id"), F.col("value").alias("headword"), "file", "entry_id")
    b = forms.select("book_id", "orth_id", F.col("value").alias("key")).join(heads, ["book_id", "orth_id"])
    return a.unionByName(b.select("key", url.alias("url"), "headword", "entry_id"))


def reader_styles(readers: DataFrame, apps: DataFrame) -> DataFrame:
    """(reader, app, styled): whether an app shows the styles that an output for a reader carries."""
    return readers.join(F.broadcast(apps), F.col("reader").startswith(F.split_part("app", F.lit("-"), F.lit(1))) | (F.col("reader") == "universal")).select("reader", "app", ((F.col("link") & F.col("sees_link")) | (F.col("inline") & F.col("sees_inline"))).alias("styled"))
