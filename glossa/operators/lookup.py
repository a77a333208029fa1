"""Lookups of many words at once, by the rules of several readers.

``queries`` has a column ``query``; ``index`` is the table of ``catalog.keys``.
Every lookup is an equality join on a key column, followed by aggregation by
(query, ordinal); nothing is looked up one word at a time.

Where ``index`` (and ``entries``) have a column ``book_id``, each book is
looked up by itself: the book is part of every join, group and rank, and of the
result. Queries with a ``book_id`` are asked of that book, others of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import readers, urls
from glossa.functions.words import ascii_lower, is_internal_key, order_key

GD_MATCHES = 10
BOOK = "book_id"


def books(df: DataFrame) -> list[str]:
    """The book column, if the table has one."""
    return [BOOK] if BOOK in df.columns else []


def _asked(queries: DataFrame, index: DataFrame) -> DataFrame:
    return queries.select(*[c for c in books(queries) if c in index.columns], "query").distinct()


def _matched(queries: DataFrame, index: DataFrame, of_query: Column, of_key: Column) -> DataFrame:
    q = _asked(queries, index).withColumn("__k", of_query)
    return q.join(index.withColumn("__k", of_key), [*books(q), "__k"]).select(*books(index), "query", "ordinal", "kind", "pos", "key")


def _hits(matched: DataFrame) -> DataFrame:
    return matched.select(*books(matched), "query", "ordinal").distinct()


def exact(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): headword or synonym equal byte for byte."""
    return _hits(_matched(queries, index, F.col("query"), F.col("key")))


def ascii_case(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): equal but for the case of A-Z."""
    return _hits(_matched(queries, index, ascii_lower(F.col("query")), ascii_lower(F.col("key"))))


def folded(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): equal without case, marks and punctuation; generated keys included."""
    return _hits(_matched(queries, index, readers.folded("query"), readers.folded("key")))


def lower_first(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): the first headword equal in lower case, else the first such synonym's target."""
    hits = _matched(queries, index, F.lower("query"), F.lower("key"))
    return hits.groupBy(*books(hits), "query").agg(F.min(F.struct("kind", "pos", "ordinal")).alias("m")).select(*books(hits), "query", F.col("m.ordinal").alias("ordinal"))


def synonyms_of(index: DataFrame, ordinal: Column) -> DataFrame:
    """The synonyms of an entry, in order; of one book's index."""
    return index.where((F.col("kind") == 1) & (F.col("ordinal") == ordinal)).orderBy("pos").select("key")


def koreader(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, rank, ordinal): exact hits, then those of the lower-case word that are new."""
    a = exact(queries, index).withColumn("pass", F.lit(0))
    low = _asked(queries, index).withColumn("low", F.lower("query")).where("low <> query")
    found = exact(low.select(*books(low), F.col("low").alias("query")), index).withColumnRenamed("query", "low")
    b = low.join(found, [*books(low), "low"]).select(*books(a), "query", "ordinal", F.lit(1).alias("pass"))
    best = a.unionByName(b).groupBy(*books(a), "query", "ordinal").agg(F.min("pass").alias("pass"))
    return _ranked(best, [F.col("pass"), F.col("ordinal")])


def _ranked(hits: DataFrame, by: list[Column], most: int | None = None) -> DataFrame:
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*books(hits), "query").orderBy(*by)).cast("long"))
    return (out.where(F.col("rank") <= most) if most else out).select(*books(hits), "query", "rank", "ordinal")


def goldendict_ng(queries: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, rank, ordinal): folded hits, those equal but for case first, each part by lower-case headword; ten at most."""
    hits = folded(queries, index).join(entries.select(*books(index), "ordinal", "word"), [*books(index), "ordinal"])
    return _ranked(hits, [F.lower("word") != F.lower("query"), F.lower("word"), F.col("ordinal")], GD_MATCHES)


def goldendict_mobile(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, rank, ordinal): exact hits, or where there are none those equal but for A-Z case."""
    a = exact(queries, index)
    b = ascii_case(queries, index).join(a.select(*books(a), "query").distinct(), [*books(a), "query"], "left_anti")
    return _ranked(a.unionByName(b), [F.col("ordinal")])


def readest(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): the lower-case hit of the first spelling that has one."""
    q = _asked(queries, index)
    tried = q.select(*books(q), F.col("query").alias("asked"), F.posexplode(readers.candidates("query")).alias("n", "query"))
    hits = tried.join(lower_first(tried, index), [*books(q), "query"])
    return hits.groupBy(*books(hits), "asked").agg(F.min(F.struct("n", "ordinal")).alias("m")).select(*books(hits), F.col("asked").alias("query"), F.col("m.ordinal").alias("ordinal"))


def kobo_blocks(index: DataFrame, entries: DataFrame) -> DataFrame:
    """(ordinal, grp, name, headword, variants): each entry's terms by group; the group's first term names it."""
    main = entries.select(*books(index), "ordinal", F.col("word").alias("main"))
    terms = index.select(*books(index), "ordinal", "kind", "pos", "key", readers.kobo_group("key").alias("grp")).join(main, [*books(index), "ordinal"])
    listed = terms.groupBy(*books(index), "ordinal", "main", "grp").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "key"))).alias("t"))
    first = F.col("t")[0]["key"]
    head = F.when(first == F.col("main"), first).otherwise(F.concat("main", F.lit(", "), first))
    rest = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: F.lower(F.trim(x.key)))
    return listed.select(*books(index), "ordinal", "grp", head.alias("headword"), rest.alias("variants")).withColumn("name", readers.kobo_name("headword"))


def kobo(queries: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, rank, ordinal, headword): blocks of the query's group named by it or listing it as a variant."""
    cand = exact(queries, index).unionByName(ascii_case(queries, index)).distinct().withColumn("grp", readers.kobo_group("query"))
    hits = cand.join(kobo_blocks(index, entries), [*books(index), "ordinal", "grp"])
    kept = hits.where((F.col("name") == F.col("query")) | F.array_contains("variants", F.lower(F.trim("query"))))
    rank = F.row_number().over(Window.partitionBy(*books(index), "query").orderBy("ordinal")).cast("long")
    return kept.withColumn("rank", rank).select(*books(index), "query", "rank", "ordinal", "headword")


def viewer(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal): exact hits, else those of the trimmed word, else of its lower-case form."""
    q = _asked(queries, index)
    forms = q.select(*books(q), "query", F.posexplode(F.array("query", F.trim("query"), F.lower(F.trim("query")))).alias("n", "form"))
    of = lambda key: index.select(*books(index), key.alias("form"), "ordinal")
    plain = forms.where("n < 2").join(of(F.col("key")), [*books(q), "form"])
    low = forms.where("n = 2").join(of(F.lower("key")), [*books(q), "form"])
    cols = [*books(index), "query", "n", "ordinal"]
    best = Window.partitionBy(*books(index), "query")
    return _hits(plain.select(*cols).unionByName(low.select(*cols)).withColumn("m", F.min("n").over(best)).where("n = m"))


def suggest(prefixes: DataFrame, index: DataFrame, most: int = 12) -> DataFrame:
    """(prefix, rank, word): the first keys that begin with a prefix but for A-Z case, generated keys hidden.

    Keys meet prefixes by equality on as many leading characters as each
    prefix has; prefixes of one length cost one pass over the distinct keys.
    """
    words = index.select(*books(index), F.col("key").alias("word")).where(~is_internal_key(F.col("word"))).distinct()
    own = [c for c in books(prefixes) if c in index.columns]
    p = prefixes.select(*own, "prefix").distinct().withColumn("low", ascii_lower(F.col("prefix"))).withColumn("len", F.length("prefix"))
    lengths = [r.len for r in p.select("len").distinct().collect()]  # a row for each length
    cut = F.explode(F.array(*[F.lit(n) for n in sorted(lengths)] or [F.lit(-1)]))
    probes = words.withColumn("len", cut).where(F.length("word") >= F.col("len")).withColumn("low", F.expr("substring(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1, len)"))
    hits = p.join(probes, [*own, "low", "len"])
    rank = F.row_number().over(Window.partitionBy(*books(index), "prefix").orderBy(*order_key(F.col("word")))).cast("long")
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select(*books(index), "prefix", "rank", "word")


def headword_at(entries: DataFrame, fraction: float) -> DataFrame:
    """The headword at a fraction of the index, skipping generated keys and going round at the end."""
    n = entries.count()
    start = min(int(fraction * n), max(0, n - 1))
    return entries.where(~is_internal_key(F.col("word"))).orderBy(F.col("ordinal") < start, "ordinal").limit(1).select("ordinal", "word")


#: Readers, their engine, whether they see linked and inline styles and resource files.
APPS = (("koreader", "mupdf", True, False, True), ("goldendict-ng", "webengine", True, True, True), ("goldendict-mobile", "webview", False, True, True), ("readest", "webview", False, True, False), ("kobo", "nickel", False, True, False))


def follow(links: DataFrame) -> DataFrame:
    """Adds ``outcome`` (kind, word, id) of tapping ``href`` in each of the readers (column ``app``).

    kind is lookup, scroll, anchor, external, not_followed or unknown;
    ``anchors`` are the ids of the entry being shown.
    """
    href, app = F.col("href"), F.col("app")
    frag = F.regexp_extract(href, "#(.*)$", 1)
    word = F.regexp_replace(href, "^bword://", "")

    def out(kind: str, word=None, ident=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), (null if word is None else word).alias("word"), (null if ident is None else ident).alias("id"))

    ko = F.when(href.contains("#") & F.array_contains("anchors", frag), out("anchor")).when(~href.startswith("bword://") & href.contains("://"), out("external")).when(word == "", out("not_followed")).otherwise(out("lookup", word))
    decoded = urls.percent_decode_lenient(F.when(F.instr(word, "#") > 1, F.split_part(word, F.lit("#"), F.lit(1))).otherwise(word))
    then = F.when(F.instr(word, "#") > 1, urls.percent_decode_lenient(F.regexp_extract(word, "^[^#]*#(.*)$", 1)))
    ng = F.when(href.startswith("#"), out("scroll", None, urls.percent_decode_lenient(F.substring(href, 2, 1 << 30)))).when(word.contains(":"), out("external")).otherwise(out("lookup", decoded, then))
    rd = F.when(href.startswith("#"), out("scroll", None, F.substring(href, 2, 1 << 30))).when(F.lower(href).rlike("^https?://"), out("external")).otherwise(out("not_followed"))
    return links.withColumn("outcome", F.when(app == "koreader", ko).when(app == "goldendict-ng", ng).when(app == "readest", rd).otherwise(out("unknown")))


def search(queries: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """(app, query, rank, ordinal) of all five readers."""
    one = lambda df, app: df.withColumn("app", F.lit(app)).select("app", *books(index), "query", "rank", "ordinal")
    first = readest(queries, index).withColumn("rank", F.lit(1).cast("long"))
    parts = [one(koreader(queries, index), "koreader"), one(goldendict_ng(queries, index, entries), "goldendict-ng"), one(goldendict_mobile(queries, index), "goldendict-mobile"), one(first, "readest"), one(kobo(queries, index, entries), "kobo")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
