"""Registered queries of the lexicon operators and the SQL that each must equal.

The tables hold no dictionaries, so the operators run on lexicon views derived
from them: a document is an entry whose headword is its first word and whose
alias is its second; benchmark words are what is looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import readers, urls, words
from glossa.operators import catalog, intervals, lookup, markup, multiset, refs
from glossa.runtime import stage, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: The word pattern of the derived views, and the SQL views that repeat them.
SPLIT = r"[ \t\n\r]+"
SQL_ITEMS = r"""items AS (
  SELECT doc_id AS id, regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+') AS ws, text FROM documents),
heads AS (SELECT id, ws[1] AS word, ws[2] AS alias, text FROM items
  WHERE strlen(ws[1]) BETWEEN 1 AND 255 AND NOT regexp_matches(ws[1], '\p{Cc}') AND NOT starts_with(ws[1], '__glossa_')),
entries AS (SELECT id, word, row_number() OVER (ORDER BY encode(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), encode(word), id) - 1 AS ordinal FROM heads),
syn AS (SELECT h.alias AS word, e.ordinal AS target FROM heads h JOIN entries e USING (id)
  WHERE h.alias IS NOT NULL AND h.alias <> '' AND strlen(h.alias) BETWEEN 1 AND 255 AND NOT regexp_matches(h.alias, '\p{Cc}')),
keys AS (SELECT word AS key, ordinal, 0 AS kind FROM entries UNION ALL SELECT word, target, 1 FROM syn),
asked AS (SELECT DISTINCT w AS query FROM (SELECT unnest(regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+')) AS w FROM benchmark) WHERE w <> '')"""
ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(col: str) -> F.Column:
    return F.split(F.regexp_replace(F.col(col), r"^[ \t\n\r]+|[ \t\n\r]+$", ""), SPLIT)


#: The first two words by one anchored pattern: a text of any length is read as far as its second word.
HEAD = r"^[ \t\n\r]*+([^ \t\n\r]++)(?:[ \t\n\r]++([^ \t\n\r]*+))?"


def items(spark: SparkSession, sf: str, docs: DataFrame | None = None, *more: F.Column) -> DataFrame:
    """(id, word, alias, payload, more...) of the documents whose first word can be a headword."""
    first = [F.regexp_extract("text", HEAD, n).alias(c) for n, c in ((1, "word"), (2, "alias"))]
    docs = table(spark, sf, "documents") if docs is None else docs
    out = docs.select(F.col("doc_id").alias("id"), *first, F.col("text").alias("payload"), *more)
    return out.where(words.headword_ok(F.col("word")))


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """(id, word, alias) of ``items``, staged: the index is built from words alone, and drawn once from the texts."""
    return stage(items(spark, sf).select("id", "word", "alias"), "heads")


def aliases(rows: DataFrame) -> DataFrame:
    return rows.where(words.key_ok(F.col("alias"))).select(*lookup.books(rows), F.col("alias").alias("word"), F.col("id").alias("target_id"))


def indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The entries in dictionary order and the table of keys."""
    rows = heads(spark, sf)
    entries = catalog.catalog(rows)
    return entries, catalog.keys(entries, catalog.synonyms(entries, aliases(rows)))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(_words("text")).alias("query")).where("query <> ''").distinct()


@query(f"WITH {SQL_ITEMS} SELECT id AS doc_id, word, sha256(text) AS payload_sha, strlen(text)::BIGINT AS payload_bytes FROM heads")
def lex_items(spark, sf):
    rows = items(spark, sf)
    return rows.select(F.col("id").alias("doc_id"), "word", words.sha256(F.col("payload")).alias("payload_sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))


@query("""WITH d AS (SELECT sha256(text) AS payload_sha, min(doc_id) AS f, max(strlen(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT payload_sha, (coalesce(sum(size) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", size FROM d""")
def payload_ranges(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    return catalog.payload_ranges(docs).withColumnRenamed("sha", "payload_sha")


@query(f"WITH {SQL_ITEMS} SELECT ordinal::BIGINT AS ordinal, word, id AS doc_id FROM entries")
def catalog_ordinals(spark, sf):
    return catalog.catalog(heads(spark, sf)).withColumnRenamed("id", "doc_id")


@query(f"""WITH {SQL_ITEMS}, d AS (SELECT sha256(text) AS sha, min(id) AS f, max(strlen(text))::BIGINT AS size FROM heads GROUP BY 1),
r AS (SELECT sha, size, (coalesce(sum(size) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM d)
SELECT e.ordinal::BIGINT AS ordinal, lower(hex(encode(e.word))) || '00' || lpad(lower(to_hex(r.off)), 8, '0') || lpad(lower(to_hex(r.size)), 8, '0') AS record
FROM entries e JOIN heads h USING (id) JOIN r ON r.sha = sha256(h.text)""")
def idx_bytes(spark, sf):
    data = F.col("payload").cast("binary")
    rows = stage(items(spark, sf).select("id", "word", F.sha2(data, 256).alias("sha"), F.octet_length(data).cast("long").alias("size")), "digests")
    placed = catalog.catalog(rows).join(rows.select("id", "sha"), "id").join(catalog.digest_ranges(rows), "sha")
    return catalog.index_records(placed).select("ordinal", words.hex_lower(F.col("record")).alias("record"))


@query(f"WITH {SQL_ITEMS} SELECT word, target::BIGINT AS target FROM syn")
def synonyms(spark, sf):
    rows = heads(spark, sf)
    return catalog.synonyms(catalog.catalog(rows), aliases(rows))


@query("""WITH d AS (SELECT sha256(text) AS s, min(doc_id) AS f, max(strlen(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT 0::BIGINT AS n_bad, sum(size)::BIGINT AS total FROM d""")
def tiling_check(spark, sf):
    ranges = payload_ranges(spark, sf).select(F.lit(1).alias("book"), "offset", "size")
    return intervals.tiling(ranges, ["book"]).select("n_bad", "total")


@query("SELECT 0::BIGINT AS n_bad")
def sorted_check(spark, sf):
    rows = catalog.catalog(heads(spark, sf)).withColumn("book", F.lit(1))
    return intervals.unsorted(rows, ["book"], "ordinal", words.order_key(F.col("word"))).select("n_bad")


@query(f"WITH {SQL_ITEMS} SELECT DISTINCT query, ordinal::BIGINT AS ordinal FROM asked JOIN keys ON key = query")
def lookup_exact(spark, sf):
    return lookup.exact(asked(spark, sf), indexed(spark, sf)[1])


@query(f"WITH {SQL_ITEMS} SELECT DISTINCT query, ordinal::BIGINT AS ordinal FROM asked JOIN keys ON {ASCII.format('key')} = {ASCII.format('query')}")
def lookup_ascii_case(spark, sf):
    return lookup.ascii_case(asked(spark, sf), indexed(spark, sf)[1])


@query(f"""WITH {SQL_ITEMS}, h AS (SELECT query, kind, ordinal, key FROM asked JOIN keys ON lower(key) = lower(query)),
m AS (SELECT query, min(kind) AS kind FROM h GROUP BY 1)
SELECT query, min(h.ordinal)::BIGINT AS ordinal FROM h JOIN m USING (query, kind) GROUP BY 1""")
def lookup_lower_first(spark, sf):
    return lookup.lower_first(asked(spark, sf), indexed(spark, sf)[1])


FOLD = "lower(regexp_replace(strip_accents({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


@query(f"WITH {SQL_ITEMS} SELECT DISTINCT query, ordinal::BIGINT AS ordinal FROM asked JOIN keys ON {FOLD.format('key')} = {FOLD.format('query')}")
def lookup_folded(spark, sf):
    return lookup.folded(asked(spark, sf), indexed(spark, sf)[1])


@query(f"""WITH {SQL_ITEMS}, h AS (SELECT query, ordinal, min(p) AS p FROM (
  SELECT query, ordinal, 0 AS p FROM asked JOIN keys ON key = query UNION ALL SELECT query, ordinal, 1 FROM asked JOIN keys ON key = lower(query)) GROUP BY 1, 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY p, ordinal) AS rank, ordinal::BIGINT AS ordinal FROM h""")
def koreader_search(spark, sf):
    return lookup.koreader(asked(spark, sf), indexed(spark, sf)[1])


@query(f"""WITH {SQL_ITEMS}, h AS (SELECT DISTINCT query, k.ordinal, e.word FROM asked JOIN keys k ON {FOLD.format('key')} = {FOLD.format('query')} JOIN entries e ON e.ordinal = k.ordinal),
r AS (SELECT query, ordinal, row_number() OVER (PARTITION BY query ORDER BY lower(word) <> lower(query), encode(lower(word)), ordinal) AS rank FROM h)
SELECT query, rank, ordinal::BIGINT AS ordinal FROM r WHERE rank <= 10""")
def gdng_top10(spark, sf):
    entries, index = indexed(spark, sf)
    return lookup.goldendict_ng(asked(spark, sf), index, entries)


@query(f"""WITH {SQL_ITEMS}, x AS (SELECT DISTINCT query, ordinal FROM asked JOIN keys ON key = query),
a AS (SELECT DISTINCT query, ordinal FROM asked JOIN keys ON {ASCII.format('key')} = {ASCII.format('query')} WHERE query NOT IN (SELECT query FROM x)),
h AS (SELECT * FROM x UNION ALL SELECT * FROM a)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY ordinal) AS rank, ordinal::BIGINT AS ordinal FROM h""")
def mobile_search(spark, sf):
    return lookup.goldendict_mobile(asked(spark, sf), indexed(spark, sf)[1])


#: The upper case of a word in SQL: that of the sharp s is two letters.
UPPER = "upper(replace({0}, 'ß', 'SS'))"
KO = """SELECT query, ordinal, min(p) AS p FROM (
  SELECT query, ordinal, 0 AS p FROM asked JOIN keys ON key = query UNION ALL SELECT query, ordinal, 1 FROM asked JOIN keys ON key = lower(query)) GROUP BY 1, 2"""
READEST = f"""re_c AS (SELECT query, unnest([query, lower(query), {UPPER.format('query[1]')} || lower(query[2:]), {UPPER.format('query')}, nfc_normalize(query), strip_accents(query)]) AS form, unnest([0, 1, 2, 3, 4, 6]) AS n FROM asked),
re_h AS (SELECT re_c.query, n, kind, ordinal FROM re_c JOIN keys ON lower(key) = lower(form)),
re AS (SELECT query, ordinal FROM (SELECT query, ordinal, row_number() OVER (PARTITION BY query ORDER BY n, kind, ordinal) AS k FROM re_h) WHERE k = 1)"""


@query(f"WITH {SQL_ITEMS}, {READEST} SELECT query, ordinal::BIGINT AS ordinal FROM re")
def readest_search(spark, sf):
    return lookup.readest(asked(spark, sf), indexed(spark, sf)[1])


#: Groups of terms without Han, Kana or Cyrillic, and blocks named by their first term.
GROUP = r"CASE WHEN regexp_full_match(lower(trim({0}[1:2])), '\p{{L}}+') THEN rpad(lower(trim({0}[1:2])), 2, 'a') ELSE '11' END"
KOBO = f"""ko_t AS (SELECT k.ordinal, k.key, e.word AS main, {GROUP.format('k.key')} AS grp, row_number() OVER (PARTITION BY k.ordinal, {GROUP.format('k.key')} ORDER BY k.kind, encode(k.key)) AS n FROM keys k JOIN entries e USING (ordinal)),
ko_b AS (SELECT ordinal, main, grp, min(key) FILTER (n = 1) AS first, coalesce(list(lower(trim(key))) FILTER (n > 1), []) AS variants FROM ko_t GROUP BY 1, 2, 3),
kobo AS (SELECT c.query, row_number() OVER (PARTITION BY c.query ORDER BY c.ordinal) AS rank, c.ordinal, CASE WHEN first = main THEN first ELSE main || ', ' || first END AS headword
  FROM (SELECT DISTINCT query, ordinal FROM asked JOIN keys ON {ASCII.format('key')} = {ASCII.format('query')}) c JOIN ko_b b ON b.ordinal = c.ordinal AND b.grp = {GROUP.format('c.query')}
  WHERE regexp_extract(first, '(?:.*, )?(.*)', 1) = c.query OR list_contains(variants, lower(trim(c.query))))"""


@query(f"WITH {SQL_ITEMS}, {KOBO} SELECT query, rank, ordinal::BIGINT AS ordinal, headword FROM kobo")
def kobo_search(spark, sf):
    entries, index = indexed(spark, sf)
    return lookup.kobo(asked(spark, sf), index, entries)


@query(f"""WITH {SQL_ITEMS}, {KOBO}, {READEST}, ko AS ({KO}),
ng_h AS (SELECT DISTINCT query, k.ordinal, e.word FROM asked JOIN keys k ON {FOLD.format('key')} = {FOLD.format('query')} JOIN entries e ON e.ordinal = k.ordinal),
ng AS (SELECT query, ordinal, row_number() OVER (PARTITION BY query ORDER BY lower(word) <> lower(query), encode(lower(word)), ordinal) AS rank FROM ng_h),
x AS (SELECT DISTINCT query, ordinal FROM asked JOIN keys ON key = query),
a AS (SELECT DISTINCT query, ordinal FROM asked JOIN keys ON {ASCII.format('key')} = {ASCII.format('query')} WHERE query NOT IN (SELECT query FROM x))
SELECT 'koreader' AS app, query, row_number() OVER (PARTITION BY query ORDER BY p, ordinal) AS rank, ordinal::BIGINT AS ordinal FROM ko
UNION ALL SELECT 'goldendict-ng', query, rank, ordinal FROM ng WHERE rank <= 10
UNION ALL SELECT 'goldendict-mobile', query, row_number() OVER (PARTITION BY query ORDER BY ordinal), ordinal FROM (SELECT * FROM x UNION ALL SELECT * FROM a)
UNION ALL SELECT 'readest', query, 1, ordinal FROM re UNION ALL SELECT 'kobo', query, rank, ordinal FROM kobo""")
def search_all(spark, sf):
    entries, index = indexed(spark, sf)
    return lookup.search(asked(spark, sf), index, entries)


#: The same views with the documents' source as the book that each entry belongs to.
SQL_BOOKS = rf"""heads AS (SELECT doc_id AS id, source AS book_id, ws[1] AS word, ws[2] AS alias FROM (SELECT doc_id, source, regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+') AS ws FROM documents)
  WHERE source IS NOT NULL AND strlen(ws[1]) BETWEEN 1 AND 255 AND NOT regexp_matches(ws[1], '\p{{Cc}}') AND NOT starts_with(ws[1], '__glossa_')),
entries AS (SELECT id, book_id, word, row_number() OVER (PARTITION BY book_id ORDER BY encode({ASCII.format('word')}), encode(word), id) - 1 AS ordinal FROM heads),
syn AS (SELECT e.book_id, h.alias AS word, e.ordinal AS target FROM heads h JOIN entries e USING (id) WHERE strlen(h.alias) BETWEEN 1 AND 255 AND NOT regexp_matches(h.alias, '\p{{Cc}}')),
keys AS (SELECT book_id, word AS key, ordinal, 0 AS kind FROM entries UNION ALL SELECT book_id, word, target, 1 FROM syn),
asked AS (SELECT DISTINCT w AS query FROM (SELECT unnest(regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+')) AS w FROM benchmark) WHERE w <> '')"""


def shelf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The entries and keys of the books that the documents' sources are."""
    docs = table(spark, sf, "documents").where("source IS NOT NULL")
    rows = items(spark, sf, docs, F.col("source").alias("book_id")).drop("payload")
    rows = stage(rows, "shelf")
    entries = catalog.catalog(rows)
    return entries, catalog.keys(entries, catalog.synonyms(entries, aliases(rows)))


@query(f"WITH {SQL_BOOKS} SELECT book_id, ordinal::BIGINT AS ordinal, word, id AS doc_id FROM entries")
def book_ordinals(spark, sf):
    return shelf(spark, sf)[0].withColumnRenamed("id", "doc_id")


@query(f"WITH {SQL_BOOKS} SELECT DISTINCT book_id, query, ordinal::BIGINT AS ordinal FROM asked JOIN keys ON {FOLD.format('key')} = {FOLD.format('query')}")
def book_lookup_folded(spark, sf):
    return lookup.folded(asked(spark, sf), shelf(spark, sf)[1])


@query(f"""WITH {SQL_BOOKS}, h AS (SELECT book_id, query, kind, ordinal FROM asked JOIN keys ON lower(key) = lower(query)),
m AS (SELECT book_id, query, min(kind) AS kind FROM h GROUP BY 1, 2) SELECT book_id, query, min(h.ordinal)::BIGINT AS ordinal FROM h JOIN m USING (book_id, query, kind) GROUP BY 1, 2""")
def book_lookup_lower_first(spark, sf):
    return lookup.lower_first(asked(spark, sf), shelf(spark, sf)[1])


@query(f"""WITH {SQL_BOOKS}, f AS (SELECT query, query AS form, 0 AS n FROM asked UNION ALL SELECT query, lower(query), 2 FROM asked),
h AS (SELECT book_id, f.query, n, ordinal FROM f JOIN keys ON (n = 0 AND key = form) OR (n = 2 AND lower(key) = form)), m AS (SELECT book_id, query, min(n) AS n FROM h GROUP BY 1, 2)
SELECT DISTINCT book_id, query, ordinal::BIGINT AS ordinal FROM h JOIN m USING (book_id, query, n)""")
def book_viewer_lookup(spark, sf):
    return lookup.viewer(asked(spark, sf), shelf(spark, sf)[1])


@query(f"""WITH {SQL_BOOKS}, ko AS (SELECT book_id, query, ordinal, min(p) AS p FROM (
  SELECT book_id, query, ordinal, 0 AS p FROM asked JOIN keys ON key = query UNION ALL SELECT book_id, query, ordinal, 1 FROM asked JOIN keys ON key = lower(query)) GROUP BY 1, 2, 3),
ng_h AS (SELECT DISTINCT k.book_id, query, k.ordinal, e.word FROM asked JOIN keys k ON {FOLD.format('key')} = {FOLD.format('query')} JOIN entries e ON e.ordinal = k.ordinal AND e.book_id = k.book_id),
ng AS (SELECT book_id, query, ordinal, row_number() OVER (PARTITION BY book_id, query ORDER BY lower(word) <> lower(query), encode(lower(word)), ordinal) AS rank FROM ng_h),
x AS (SELECT DISTINCT book_id, query, ordinal FROM asked JOIN keys ON key = query),
a AS (SELECT DISTINCT book_id, query, ordinal FROM asked JOIN keys ON {ASCII.format('key')} = {ASCII.format('query')} WHERE (book_id, query) NOT IN (SELECT (book_id, query) FROM x)),
{READEST.replace('SELECT query, ordinal', 'SELECT book_id, query, ordinal').replace('SELECT re_c.query', 'SELECT book_id, re_c.query').replace('PARTITION BY query', 'PARTITION BY book_id, query')},
{KOBO.replace('k.ordinal, k.key', 'k.book_id, k.ordinal, k.key').replace('PARTITION BY k.ordinal', 'PARTITION BY k.book_id, k.ordinal').replace('USING (ordinal)', 'USING (book_id, ordinal)').replace('SELECT ordinal, main', 'SELECT book_id, ordinal, main').replace('GROUP BY 1, 2, 3', 'GROUP BY 1, 2, 3, 4').replace('SELECT c.query', 'SELECT c.book_id, c.query').replace('PARTITION BY c.query', 'PARTITION BY c.book_id, c.query').replace('DISTINCT query', 'DISTINCT book_id, query').replace('b.ordinal = c.ordinal', 'b.book_id = c.book_id AND b.ordinal = c.ordinal')}
SELECT 'koreader' AS app, book_id, query, row_number() OVER (PARTITION BY book_id, query ORDER BY p, ordinal) AS rank, ordinal::BIGINT AS ordinal FROM ko
UNION ALL SELECT 'goldendict-ng', book_id, query, rank, ordinal FROM ng WHERE rank <= 10
UNION ALL SELECT 'goldendict-mobile', book_id, query, row_number() OVER (PARTITION BY book_id, query ORDER BY ordinal), ordinal FROM (SELECT * FROM x UNION ALL SELECT * FROM a)
UNION ALL SELECT 'readest', book_id, query, 1, ordinal FROM re UNION ALL SELECT 'kobo', book_id, query, rank, ordinal FROM kobo""")
def book_search_all(spark, sf):
    entries, index = shelf(spark, sf)
    return lookup.search(asked(spark, sf), index, entries)


@query(f"""WITH {SQL_ITEMS}, p AS (SELECT DISTINCT query[1:2] AS prefix FROM asked), w AS (SELECT DISTINCT key AS word FROM keys),
r AS (SELECT prefix, word, row_number() OVER (PARTITION BY prefix ORDER BY encode({ASCII.format('word')}), encode(word)) AS rank FROM p JOIN w ON starts_with({ASCII.format('word')}, {ASCII.format('prefix')}))
SELECT prefix, rank, word FROM r WHERE rank <= 12""")
def suggest(spark, sf):
    prefixes = asked(spark, sf).select(F.substring("query", 1, 2).alias("prefix"))
    return lookup.suggest(prefixes, indexed(spark, sf)[1])


@query(f"""WITH {SQL_ITEMS}, f AS (SELECT query, query AS form, 0 AS n FROM asked UNION ALL SELECT query, lower(query), 2 FROM asked),
h AS (SELECT f.query, n, ordinal FROM f JOIN keys ON (n = 0 AND key = form) OR (n = 2 AND lower(key) = form)), m AS (SELECT query, min(n) AS n FROM h GROUP BY 1)
SELECT DISTINCT query, ordinal::BIGINT AS ordinal FROM h JOIN m USING (query, n)""")
def viewer_lookup(spark, sf):
    return lookup.viewer(asked(spark, sf), indexed(spark, sf)[1])


@query(r"""WITH a AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+')) AS w FROM benchmark) GROUP BY 1),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text, E' \t\n\r'), '[ \t\n\r]+')) AS w FROM documents) GROUP BY 1)
SELECT coalesce(a.w, b.w) AS word, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right FROM a FULL JOIN b ON a.w = b.w WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark, sf):
    of = lambda t: table(spark, sf, t).select(F.explode(_words("text")).alias("word"))
    return multiset.difference(of("benchmark"), of("documents"), ["word"])


@query("""WITH f AS (SELECT l_orderkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey AS a, l_partkey AS b, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2)
SELECT coalesce(sum(greatest(coalesce(f.n, 0) - coalesce(r.n, 0), 0)), 0)::BIGINT AS n_missing, coalesce(sum(greatest(coalesce(r.n, 0) - coalesce(f.n, 0), 0)), 0)::BIGINT AS n_extra FROM f FULL JOIN r ON f.a = r.a AND f.b = r.b""")
def reverse_edges(spark, sf):
    lines = table(spark, sf, "lineitem")
    forward = lines.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    back = lines.where("l_linenumber < 4").select(F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("a"))
    return multiset.totals(multiset.difference(forward, back, ["a", "b"]))


def _spans(spark, sf) -> DataFrame:
    start, n = F.col("l_partkey") * 10, F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey"), start.alias("start"), (start + n).alias("end"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))


SQL_SPANS = "spans AS (SELECT l_suppkey AS suppkey, l_partkey * 10 AS s, l_partkey * 10 + CAST(trunc(l_quantity) AS BIGINT) AS e, l_orderkey * 8 + l_linenumber AS id FROM lineitem)"


@query(f"""WITH {SQL_SPANS}, b AS (SELECT max(e) + 100 AS bound FROM spans),
w AS (SELECT suppkey, coalesce(max(e) OVER (PARTITION BY suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, s FROM spans)
SELECT suppkey, f AS "start", s AS "end" FROM w WHERE f < s UNION ALL SELECT suppkey, max(e), (SELECT bound FROM b) FROM spans GROUP BY 1""")
def span_gaps(spark, sf):
    spans = _spans(spark, sf)
    bound = spans.agg(F.max("end") + 100).first()[0]
    return intervals.gaps(spans, spans.select("suppkey").distinct().withColumn("bound", F.lit(bound)), "suppkey")


@query(f"""WITH {SQL_SPANS}, w AS (SELECT suppkey, s, e, coalesce(max(e) OVER (PARTITION BY suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM spans)
SELECT suppkey, sum(greatest(0, e - greatest(s, f)))::BIGINT AS length FROM w GROUP BY 1""")
def span_cover(spark, sf):
    return intervals.covered_length(_spans(spark, sf), "suppkey")


@query(f"""WITH {SQL_SPANS}, p AS (SELECT DISTINCT o_custkey * 10 AS pos FROM orders)
SELECT pos, (SELECT arg_min(id, (e - s) * 1000000000 + id) FROM spans WHERE s <= pos AND pos < e) AS owner FROM p""")
def span_owner(spark, sf):
    points = table(spark, sf, "orders").select(F.lit(1).alias("book"), (F.col("o_custkey") * 10).alias("pos")).distinct()
    return intervals.owners(points, _spans(spark, sf).withColumn("book", F.lit(1)), ["book"]).select("pos", "owner")


@query("""WITH z AS (SELECT p_partkey AS partkey, p_partkey // 3 AS s, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_partkey // 3 % 5 + 1 END AS len FROM part),
r AS (SELECT s, min(len) AS lo, max(len) AS hi FROM z WHERE len > 0 GROUP BY 1)
SELECT partkey, (CASE WHEN len > 0 THEN len WHEN lo = hi THEN lo END)::BIGINT AS len FROM z LEFT JOIN r USING (s)""")
def zero_length(spark, sf):
    start = F.expr("p_partkey div 3")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), start.alias("start"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(start % 5 + 1).cast("long").alias("len"))
    return refs.resolve_zero_lengths(rows, []).select("partkey", "len")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS r FROM part),
w AS (SELECT k, k AS at, 0 AS d FROM t UNION ALL SELECT w.k, t.r, d + 1 FROM w JOIN t ON t.k = w.at WHERE t.r IS NOT NULL),
m AS (SELECT k, max(d) AS d FROM w GROUP BY 1) SELECT w.k AS partkey, w.at AS root, w.d::BIGINT AS depth FROM w JOIN m ON m.k = w.k AND m.d = w.d""")
def shared_refs(spark, sf):
    half = F.expr("p_partkey div 2")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.when(half > 0, half).alias("ref"))
    return refs.resolve_references(rows, "partkey")


@query("""WITH c AS (SELECT event_id, 'click' AS role FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'loss' FROM events WHERE value < 0 UNION ALL SELECT event_id, 'even' FROM events WHERE user_id % 2 = 0),
b AS (SELECT event_id, count(*) AS n, min(role) AS role FROM c GROUP BY 1)
SELECT e.event_id, CASE WHEN n = 1 THEN role END AS role, coalesce(n, 0)::BIGINT AS n_claims FROM events e LEFT JOIN b USING (event_id)""")
def role_partition(spark, sf):
    events = table(spark, sf, "events")
    claim = lambda cond, role: events.where(cond).select("event_id", F.lit(role).alias("role"))
    claims = claim("event_type = 'click'", "click").union(claim("value < 0", "loss")).union(claim("user_id % 2 = 0", "even"))
    return multiset.roles(claims, events, "event_id")


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY 1), s AS (SELECT roles, min(conv_id) AS f FROM l GROUP BY 1)
SELECT conv_id, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS set_id FROM s JOIN l USING (roles)""".replace("SELECT conv_id, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS set_id FROM s JOIN l USING (roles)", "SELECT l.conv_id, n.set_id FROM l JOIN (SELECT roles, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS set_id FROM s) n USING (roles)"))
def style_sets(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("roles"))
    return multiset.style_sets(turns, "conv_id", "roles").select("conv_id", "set_id")


@query("SELECT reader, page_id, CASE WHEN reader IN ('koreader', 'goldendict') THEN 61 WHEN reader = 'universal' THEN 61 + 26 ELSE 26 END::BIGINT AS prefix_bytes FROM pages, (SELECT unnest(['koreader', 'goldendict', 'goldendict-mobile', 'readest', 'kobo', 'universal']) AS reader)")
def delivery_matrix(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<style>([^<]*)</style>", 1).alias("css"))
    each = pages.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("reader"), F.lit(a).alias("link"), F.lit(b).alias("inline")) for n, a, b in words.READERS])))
    return each.select("r.reader", "page_id", F.octet_length(words.style_prefix(F.col("r.link"), F.col("r.inline"), F.col("css"))).cast("long").alias("prefix_bytes"))


@query("""WITH n AS (SELECT doc_id, sha256('book') AS ns FROM documents), k AS (SELECT doc_id, '__glossa_' || ns || '_entry_' || lpad(lower(to_hex(doc_id)), 16, '0') AS key, 'glo-' || ns || '-e' || doc_id AS route, 'glo-' || ns || '-p' || doc_id AS page, 'glo_' || ns[1:16] AS class FROM n)
SELECT doc_id, key, route, page, class, true AS internal FROM k""")
def routes(spark, sf):
    ns = F.sha2(F.lit("book").cast("binary"), 256)
    rows = table(spark, sf, "documents").select("doc_id", words.routing_key(ns, F.col("doc_id")).alias("key"), words.entry_route(ns, F.col("doc_id")).alias("route"), words.page_route(ns, F.col("doc_id")).alias("page"), words.scope_class(ns).alias("class"))
    return rows.withColumn("internal", words.is_internal_key(F.col("key")) & words.is_internal_key(F.col("route")) & words.is_internal_key(F.concat("page", F.lit("#x"))))


@query(f"WITH {SQL_ITEMS} SELECT query AS word, url_encode(query) AS enc, query AS back FROM asked")
def percent_roundtrip(spark, sf):
    enc = urls.percent_encode(F.col("query"))
    return asked(spark, sf).select(F.col("query").alias("word"), enc.alias("enc"), urls.percent_decode(enc).alias("back"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
x AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS pre FROM s, unnest(range(1, len(parts) + 1)) AS t(n)) SELECT lower(pre) AS key, count(*)::BIGINT AS n FROM x GROUP BY 1 HAVING count(*) > 1""")
def path_collisions(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")).distinct()
    return multiset.path_collisions(paths)


@query("SELECT url AS path, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages")
def manifest(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("bytes"), words.sha256(F.col("html")).alias("sha256"))


@query(r"""SELECT page_id, strlen(regexp_replace('[Chapter ' || lpad((page_id + 1)::VARCHAR, 6, '0') || '] ' || regexp_extract(html, '<title>([^<]*)</title>', 1), '\p{Cc}', '', 'g'))::BIGINT AS key_bytes FROM pages
WHERE strlen(regexp_extract(html, '<title>([^<]*)</title>', 1)) < 200""")
def chapter_keys(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    prefix = words.label(F.lit("en"), "chapter", F.col("page_id") + 1)
    return pages.select("page_id", F.octet_length(readers.chapter_key(prefix, "title")).cast("long").alias("key_bytes"))


@query(r"""WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script', '\1</script', 'gs'), '<([A-Za-z][A-Za-z0-9]*)[^>]*>', 1))) AS tag FROM pages)
SELECT page_id, tag, count(*)::BIGINT AS n FROM t GROUP BY 1, 2""")
def page_tokens(spark, sf):
    tags = markup.tokens(table(spark, sf, "pages").select("page_id", "html"), "page_id", "html").where("kind = 'tag' AND NOT closing")
    return tags.groupBy("page_id", F.col("name").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]*>', '', 'gs'),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s ]+', ' ', 'g'))) AS text_sha FROM pages""")
def page_text(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", words.sha256(markup.plain_text(F.col("html"))).alias("text_sha"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)
SELECT page_id, unnest(range(len(hs)))::BIGINT AS seq, unnest(hs) AS href FROM h""")
def page_links(spark, sf):
    return markup.links(table(spark, sf, "pages"), "page_id", "html").select("page_id", "seq", "href")


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS hs FROM pages), u AS (SELECT page_id, unnest(range(len(hs)))::BIGINT AS seq, unnest(hs) AS href FROM h)
SELECT page_id, seq, 'internal' AS kind, 'book/' || href AS file FROM u WHERE href <> '' AND NOT regexp_matches(href, '[:?#%\\]')""")
def resolve_links(spark, sf):
    found = markup.links(table(spark, sf, "pages"), "page_id", "html").withColumn("href", F.regexp_replace("href", "^/", "")).where(~F.col("href").rlike(r"[:?#%\\]") & (F.col("href") != ""))
    return found.withColumn("t", urls.resolve(F.lit("book/page.xhtml"), F.col("href"))).select("page_id", "seq", "t.kind", "t.file")


@query()
def resolve_all_links(spark, sf):
    """Every link of the pages as it stands, with what the strict grammar makes of it."""
    found = markup.links(table(spark, sf, "pages"), "page_id", "html")
    return found.withColumn("t", urls.resolve(F.lit("book/page.xhtml"), F.col("href"))).select("page_id", "seq", "t.kind", "t.file", "t.anchor")


@query("SELECT page_id, regexp_extract(html, '<style>([^<]*)</style>', 1) AS css, '.glo_x ' || regexp_extract(html, '<style>([^<]*)</style>', 1) AS scoped FROM pages")
def scoped_css(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<style>([^<]*)</style>", 1).alias("css"))
    return pages.select("page_id", "css", markup.scope_css(F.col("css"), F.lit("glo_x")).alias("scoped"))


@query("SELECT page_id, CASE WHEN contains(html, '<script') THEN 'UNSUPPORTED' END AS code FROM pages")
def html_gate(spark, sf):
    return markup.gate(table(spark, sf, "pages"), "page_id", "html").select("page_id", "code")


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escaped_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", words.escape_html(F.col("url")).alias("escaped"))


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""WITH {SQL_ITEMS}, a AS (SELECT id, {ESC.format('word')} AS w, {ESC.format('text')} AS t FROM heads)
SELECT id AS doc_id, sha256('<div class="entry"><div class="glo-header"><span class="hw">' || w || '</span> <span class="glo-pos"><small>N</small></span></div><div class="glo-sense"> ' || t || '</div></div>') AS html_sha, 1::BIGINT AS headers FROM a""")
def layout_profile(spark, sf):
    esc = lambda c: words.escape_html(F.col(c))
    article = F.concat(F.lit('<div class="entry"><span class="hw">'), esc("word"), F.lit("</span> <small>N</small> "), esc("payload"), F.lit("</div>"))
    laid = items(spark, sf).select(F.col("id").alias("doc_id"), markup.readable(article).alias("r"))
    return laid.select("doc_id", words.sha256(F.col("r.html")).alias("html_sha"), F.col("r.counts")["headers"].alias("headers"))
