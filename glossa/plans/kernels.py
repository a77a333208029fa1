"""Registered queries of column functions, kernels and book checks, on columns made from the tables, with their SQL.

They join ``catalogue``'s registry; inputs hold the faults that a check is for,
so that a query that found nothing would not match its SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from glossa.functions import codecs, readers, urls, words
from glossa.operators import bundle, crosscheck, intervals, markup, multiset
from glossa.plans.catalogue import SQL_ITEMS, asked, heads, query
from glossa.runtime import stage, table
from glossa.sources import books, pack

ASKED = f"WITH {SQL_ITEMS}"


def _hex(data):
    return F.lower(F.hex(data))


@query("SELECT doc_id, doc_id::BIGINT AS n FROM documents")
def vint_numbers(spark, sf):
    n = F.col("doc_id")
    part = lambda shift, high: F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND(127) + high), 2, "0")
    return table(spark, sf, "documents").select("doc_id", codecs.vint(F.unhex(F.concat(part(21, 0), part(14, 0), part(7, 0), part(0, 128)))).alias("n"))


@query("SELECT doc_id, sha256(text) AS text_sha, true AS smaller FROM documents WHERE length(text) BETWEEN 200 AND 4000")
def palmdoc_text(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text").between(200, 4000))
    small = docs.select("doc_id", "text", codecs.packed(F.col("text").cast("binary")).alias("p"))
    return small.select("doc_id", words.sha256(codecs.unpacked(F.col("p"))).alias("text_sha"), (F.octet_length("p") < 1.1 * F.octet_length("text")).alias("smaller"))


@query(rf"""{ASKED}, p AS (SELECT query AS word, unnest(['s', 'end', 'pre', 'cut', 'gone']) AS kind FROM asked)
SELECT word, kind, CASE kind WHEN 's' THEN word || 's' WHEN 'end' THEN word || 'ed' WHEN 'pre' THEN 're' || word
  WHEN 'cut' THEN CASE WHEN ends_with(word, 'e') AND word <> 'e' THEN word[:-2] END
  ELSE CASE WHEN word <> 'th' AND starts_with(word, 'th') THEN word[3:] END END AS form FROM p""")
def inflections(spark, sf):
    programs = {"s": b"s", "end": b"\x02de", "pre": b"\x01re", "cut": b"\x03e", "gone": b"\x04th"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("program")) for k, v in programs.items()]))
    rows = asked(spark, sf).select(F.col("query").alias("word"), each.alias("p"))
    return rows.select("word", "p.kind", codecs.inflected(F.col("word"), F.col("p.program")).alias("form"))


@query("SELECT doc_id, chr(8364) || ' ' || chr(233) || doc_id AS word FROM documents")
def windows_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", codecs.windows_1252(F.concat(F.unhex(F.lit("8020E9")), F.col("doc_id").cast("string").cast("binary"))).alias("word"))


@query("SELECT doc_id, sha256(text) AS text_sha FROM documents")
def trailer_text(spark, sf):
    record = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("787883")))
    return table(spark, sf, "documents").select("doc_id", words.sha256(codecs.without_trailers(record, F.lit(2))).alias("text_sha"))


@query(f"{ASKED} SELECT query AS word, 'b/' || query AS clean FROM asked WHERE NOT contains(query, '/')")
def clean_paths(spark, sf):
    q = asked(spark, sf).where(~F.col("query").contains("/"))
    return q.select(F.col("query").alias("word"), urls.clean_path(F.concat(F.lit("../a/./.."), F.lit("//b/"), "query", F.lit("/x/../."))).alias("clean"))


@query(f"{ASKED} SELECT query AS word, '../../c/' || url_encode(query) AS path FROM asked WHERE NOT contains(query, '/')")
def relative_paths(spark, sf):
    q = asked(spark, sf).where(~F.col("query").contains("/"))
    return q.select(F.col("query").alias("word"), urls.relative_path(F.lit("a/b/d/page.html"), F.concat(F.lit("a/c/"), F.col("query"))).alias("path"))


@query(f"""{ASKED}, k AS (SELECT query AS word, unnest(['//res/', 'HTTP://h/', 'data:', 'x/%zz']) AS head FROM asked)
SELECT word, head, CASE head WHEN '//res/' THEN 'res/' || word WHEN 'x/%zz' THEN 'x/%zz' || word END AS path FROM k""")
def resource_paths(spark, sf):
    head = F.explode(F.array(*map(F.lit, ("//res/", "HTTP://h/", "data:", "x/%zz"))))
    q = asked(spark, sf).select(F.col("query").alias("word"), head.alias("head"))
    return q.select("word", "head", urls.resource_path(F.concat("head", urls.percent_encode(F.col("word")))).alias("path"))


@query(r"""WITH p AS (SELECT page_id, unnest(['', '../', '/', 'a//', 'C:', 'a\', 'x./', 'x /', 'ok/']) AS head, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, head, head || path AS path, string_split(head || path, '/') AS parts FROM p)
SELECT page_id, head, strlen(path) <= 4096 AND len(parts) <= 64 AND NOT regexp_matches(path, '[\\:\x00-\x1f\x7f-\x{9f}]') AND len(list_filter(parts, lambda x: x IN ('', '.', '..') OR ends_with(x, '.') OR ends_with(x, ' '))) = 0 AS ok FROM s""")
def package_paths(spark, sf):
    heads = F.explode(F.array(*map(F.lit, ("", "../", "/", "a//", "C:", "a\\", "x./", "x /", "ok/"))))
    pages = table(spark, sf, "pages").select("page_id", heads.alias("head"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return pages.select("page_id", "head", urls.package_path_ok(F.concat("head", "path")).alias("ok"))


@query("SELECT page_id, url AS back FROM pages")
def unescaped_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", words.unescape_basic(words.escape_html(F.col("url"), apostrophe=False)).alias("back"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s ]+', ' ', 'g'))) AS text_sha FROM documents")
def collapsed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", words.sha256(words.collapse_space(F.col("text"))).alias("text_sha"))


SQL_IMAGES = """m AS (SELECT doc_id, from_hex(['89504E470D0A1A0A', 'FFD8FF', '474946383761', '474946383961', '424D', '00'][doc_id % 6 + 1]) || encode(text) AS data,
  ['png', 'jpg', 'gif', 'gif', 'bmp', NULL][doc_id % 6 + 1] AS ext, ['image/png', 'image/jpeg', 'image/gif', 'image/gif', 'image/bmp', NULL][doc_id % 6 + 1] AS media FROM documents)"""


@query(f"WITH {SQL_IMAGES} SELECT doc_id, 'image-' || lpad(doc_id::VARCHAR, 6, '0') || '.' || ext AS file, sha256('data:' || media || ';base64,' || base64(data)) AS uri_sha FROM m")
def image_files(spark, sf):
    magic = F.element_at(F.array(*map(F.lit, ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "00"))), (F.col("doc_id") % 6 + 1).cast("int"))
    data = table(spark, sf, "documents").select("doc_id", F.concat(F.unhex(magic), F.col("text").cast("binary")).alias("data"))
    uri = words.data_uri(words.image_type(F.col("data"))["media_type"], F.col("data"))
    return data.select("doc_id", words.image_file(F.col("doc_id"), F.col("data")).alias("file"), words.sha256(uri).alias("uri_sha"))


@query("SELECT doc_id, doc_id::BIGINT AS n, true AS short FROM documents")
def big_endian(spark, sf):
    data = F.unhex(F.concat(F.lit("FFFF"), F.lpad(F.hex("doc_id"), 8, "0")))
    return table(spark, sf, "documents").select("doc_id", words.be(data, 2, 4).alias("n"), words.be(data, 4, 4).isNull().alias("short"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '词典' ELSE 'Dictionary' END ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN '补充 ' ELSE 'supplement ' END || doc_id AS label FROM documents")
def book_titles(spark, sf):
    lang = F.when(F.col("doc_id") % 2 == 0, "zh").otherwise(F.coalesce("lang", F.lit("x")))
    title = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", words.title_or_label(title, lang).alias("title"), words.label(lang, "supplement", F.col("doc_id")).alias("label"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]') AND doc_id % 4 <> 0 AND doc_id % 4 <> 1 AS ok FROM documents")
def text_checks(spark, sf):
    tail = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("07"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("C328"))).otherwise(F.unhex(F.lit("0D0A09")))
    return table(spark, sf, "documents").select("doc_id", bundle.text_ok(F.concat(F.col("text").cast("binary"), tail)).alias("ok"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_partkey * 10 AS s, l_partkey * 10 + CAST(trunc(l_quantity) AS BIGINT) * 400 AS e, l_linenumber AS n FROM lineitem),
w AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT k AS orderkey, s AS "start", count(*)::BIGINT AS n FROM w WHERE s < b GROUP BY 1, 2""")
def overlapping_spans(spark, sf):
    start, size = F.col("l_partkey") * 10, F.col("l_quantity").cast("long") * 400
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), start.alias("start"), (start + size).alias("end"))
    return intervals.overlapping(spans, "orderkey").groupBy("orderkey", "start").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS o, CAST(trunc(l_quantity) AS BIGINT) % 3 AS n FROM lineitem), w AS (SELECT k, o, n, coalesce(lag(o + n) OVER (PARTITION BY k ORDER BY o, n), 0) <> o AS bad FROM r)
SELECT k AS suppkey, sum(bad::BIGINT)::BIGINT AS n_bad, max(o + n)::BIGINT AS total FROM w GROUP BY 1""")
def tiling_faults(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").cast("long").alias("offset"), (F.col("l_quantity").cast("long") % 3).alias("size"))
    return intervals.tiling(rows, ["suppkey"])


@query("""WITH w AS (SELECT user_id, event_type < lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events)
SELECT user_id, coalesce(sum(bad::BIGINT), 0)::BIGINT AS n_bad FROM w GROUP BY 1""")
def order_faults(spark, sf):
    return intervals.unsorted(table(spark, sf, "events"), ["user_id"], "event_id", [F.col("event_type")])


@query("""WITH p AS (SELECT DISTINCT lower(p_type) AS t, p_size AS n FROM part), f AS (SELECT CASE WHEN n % 4 = 0 THEN 'lib/' || t ELSE 'lib/' || t || n % 2 || '/' || n END AS path FROM p UNION ALL SELECT 'lib/' || t || '1' FROM p),
d AS (SELECT DISTINCT path FROM f), x AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS dir FROM (SELECT string_split(path, '/') AS s FROM d) t, unnest(range(1, len(s))) AS u(n))
SELECT path FROM d WHERE path IN (SELECT dir FROM x)""")
def file_directory_clashes(spark, sf):
    kind, n = F.concat(F.lit("lib/"), F.lower("p_type")), F.col("p_size")
    own = F.when(n % 4 == 0, kind).otherwise(F.concat(kind, (n % 2).cast("string"), F.lit("/"), n.cast("string")))
    paths = table(spark, sf, "part").select(F.explode(F.array(own, F.concat(kind, F.lit("1")))).alias("path")).distinct()
    return multiset.file_directory_clashes(paths).select("path")


@query("""WITH p AS (SELECT DISTINCT p_type AS t, p_partkey % 3 AS k FROM part), s AS (SELECT DISTINCT CASE k WHEN 0 THEN upper(t) WHEN 1 THEN lower(t) ELSE t END AS path FROM p)
SELECT lower(path) AS key, count(*)::BIGINT AS n FROM s GROUP BY 1 HAVING count(*) > 1""")
def spelling_collisions(spark, sf):
    k = F.col("p_partkey") % 3
    return multiset.path_collisions(table(spark, sf, "part").select(F.when(k == 0, F.upper("p_type")).when(k == 1, F.lower("p_type")).otherwise(F.col("p_type")).alias("path")))


@query("""WITH a AS (SELECT o_custkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, [o_orderpriority] AS want FROM orders),
c AS (SELECT o_custkey AS b, o_orderkey // 2 AS s, list_sort(list(o_orderpriority)) AS have FROM orders GROUP BY 1, 2), r AS (SELECT b, have, row_number() OVER (PARTITION BY b ORDER BY s) AS k FROM c)
SELECT coalesce(a.b, r.b) AS book_id, coalesce(a.k, r.k) AS k, (want IS NOT DISTINCT FROM have) AS same FROM a FULL JOIN r ON a.b = r.b AND a.k = r.k""")
def paired_definitions(spark, sf):
    orders = table(spark, sf, "orders")
    source = orders.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("pos"), F.array("o_orderpriority").alias("words"))
    half = F.expr("o_orderkey div 2")
    compiled = orders.select(F.col("o_custkey").alias("book_id"), half.alias("start"), (half + 1).alias("end"), F.col("o_orderpriority").alias("word"))
    return crosscheck.definitions(source, compiled).select("book_id", F.col("k").cast("long").alias("k"), "same")


@query("""WITH f AS (SELECT l_suppkey AS b, l_partkey % 50 AS g, l_linenumber AS r FROM lineitem), k AS (SELECT * FROM f WHERE (b + g + r) % 7 <> 0 AND b % 3 <> 0), w AS (SELECT * FROM f WHERE b IN (SELECT b FROM k)),
x AS (SELECT b, g, r, sum(l) AS l, sum(q) AS q FROM (SELECT *, 1 AS l, 0 AS q FROM w UNION ALL SELECT *, 0, 1 FROM k) GROUP BY 1, 2, 3)
SELECT b AS book_id, g AS "group", r AS rule, l::BIGINT AS n_left, q::BIGINT AS n_right FROM x WHERE l <> q""")
def one_way_rules(spark, sf):
    forward = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book_id"), (F.col("l_partkey") % 50).alias("group"), F.col("l_linenumber").alias("rule"))
    back = forward.where(((F.col("book_id") + F.col("group") + F.col("rule")) % 7 != 0) & (F.col("book_id") % 3 != 0))
    return crosscheck.reverse_rules(forward, back)


@query("""WITH s AS (SELECT p_partkey % 20 AS b, sum(p_size)::BIGINT AS n FROM part GROUP BY 1) SELECT b AS book_id, n > 250 AS over FROM s WHERE n > 250""")
def book_budgets(spark, sf):
    files = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("book_id"), F.col("p_size").cast("long").alias("bytes"))
    return bundle.budget_failures(files, 250).select(F.col("key").cast("long").alias("book_id"), (F.col("code") == "LIMIT").alias("over"))


@query("""WITH e AS (SELECT url AS path, strlen(html)::BIGINT AS n, sha256(html) AS s FROM pages WHERE page_id % 5 <> 1), f AS (SELECT url AS path, strlen(html)::BIGINT + (page_id % 7 = 0)::BIGINT AS n, sha256(html) AS s FROM pages WHERE page_id % 11 <> 2),
x AS (SELECT path, n, s, sum(l) AS l, sum(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM e UNION ALL SELECT *, 0, 1 FROM f) GROUP BY 1, 2, 3) SELECT path, n AS bytes, s AS sha256, l::BIGINT AS n_left, r::BIGINT AS n_right FROM x WHERE l <> r""")
def manifest_faults(spark, sf):
    pages = table(spark, sf, "pages")
    listed = bundle.manifest(pages.where("page_id % 5 <> 1").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")))
    found = bundle.manifest(pages.where("page_id % 11 <> 2").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"), "page_id").drop("page_id"))
    off = pages.where("page_id % 11 <> 2 AND page_id % 7 = 0").select(F.col("url").alias("path"), (F.octet_length("html") + 1).cast("long").alias("bytes"), words.sha256(F.col("html")).alias("sha256"))
    rest = bundle.manifest(pages.where("page_id % 11 <> 2 AND page_id % 7 <> 0").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")))
    assert found.columns == rest.columns
    return bundle.manifest_failures(listed, rest.unionByName(off))


@query("""WITH c AS (SELECT c_custkey AS b, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'p{' || c_name || '}' END AS css, c_custkey % 2 = 0 AS link FROM customer)
SELECT b AS book_id, path, css FROM (SELECT b, css, unnest(CASE WHEN css = '' THEN [] WHEN link THEN ['dictionary.css', 'res/dictionary.css'] ELSE ['dictionary.css'] END) AS path FROM c)""")
def style_files(spark, sf):
    k = F.col("c_custkey")
    books = table(spark, sf, "customer").select(k.alias("book_id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("p{"), "c_name", F.lit("}"))).alias("css"), (k % 2 == 0).alias("link"))
    return bundle.stylesheet_files(books)


@query("""SELECT s_nationkey AS book_id, '<h1>N&amp;' || s_nationkey || '</h1>' || string_agg('<figure><img src="res/' || s_suppkey || '.png"/><figcaption>&lt;' || s_name || '&gt;</figcaption></figure>', '' ORDER BY s_suppkey) AS html FROM supplier GROUP BY 1""")
def image_galleries(spark, sf):
    s = table(spark, sf, "supplier")
    key = lambda c: F.col(c).cast("string")
    rows = s.select(F.col("s_nationkey").alias("book_id"), F.concat(F.lit("N&"), key("s_nationkey")).alias("title"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("<"), "s_name", F.lit(">")).alias("label"), F.concat(F.lit("res/"), key("s_suppkey"), F.lit(".png")).alias("path"))
    return bundle.gallery(rows)


@query(r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]*>', '', 'gs'),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s ]+', ' ', 'g'))) AS text_sha FROM pages""")
def exact_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", words.sha256(F.trim(F.regexp_replace(markup.visible_text(F.col("html")), r"[\s ]+", " "))).alias("text_sha"))


@query("SELECT page_id, sha256('<!doctype html>' || html[16:] || '<!-- ' || page_id || ' -->') AS html_sha FROM pages")
def replayed_pages(spark, sf):
    size = F.octet_length("html").cast("long")
    edit = lambda a, b, text: F.struct(a.alias("start"), b.alias("end"), text.cast("binary").alias("replacement"))
    edits = F.array(edit(size, size, F.concat(F.lit("<!-- "), F.col("page_id").cast("string"), F.lit(" -->"))), edit(F.lit(0).cast("long"), F.lit(15).cast("long"), F.lit("<!doctype html>")))
    pages = table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("data"), edits.alias("edits"))
    return pages.select("page_id", F.sha2(markup.replay(F.col("data"), F.col("edits")), 256).alias("html_sha"))


@query("SELECT page_id, '.k' || page_id || ' h1,.k' || page_id || ' h2 b{color:red}@media screen{.k' || page_id || ' p{margin:0}}' AS css FROM pages")
def scoped_rules(spark, sf):
    name = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(markup.scope_css(F.lit("h1, h2 b{color:red}@media screen{p{margin:0}}"), name), r",\s*", ",").alias("css"))


@query("""WITH q AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT event_id, user_id, event_type FROM q WHERE n = 1""")
def first_events(spark, sf):
    return markup.first_positions(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 9 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 3)
SELECT coalesce(a.k, b.k) AS orderkey, a.s AS want, b.s AS got FROM a FULL JOIN b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s""")
def order_mismatches(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))
    other = orders.where("orderkey % 10 <> 3").withColumn("status", F.when(F.col("orderkey") % 8 == 0, "Z").otherwise(F.col("status")))
    return bundle.mismatches(orders.where("orderkey % 9 <> 0"), other, ["orderkey"], ["status"]).select("orderkey", F.col("want.status").alias("want"), F.col("got.status").alias("got"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
f AS (SELECT page_id, strlen(t) <= 120 AS whole, CASE WHEN strlen(t) <= 120 THEN trim(array_to_string(list_filter(string_split(regexp_replace(t, '[/\\:*?"<>|\x00-\x1f\x7f]', ' ', 'g'), ' '), lambda x: x <> ''), ' '), '. ') END AS name FROM t)
SELECT page_id, whole, CASE WHEN regexp_matches(upper(rtrim(split_part(name, '.', 1))), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || name ELSE name END AS name FROM f""".replace("\x00", r"\x00").replace("\x1f", r"\x1f").replace("\x7f", r"\x7f"))
def folder_names(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    whole = F.octet_length("t") <= 120
    return pages.select("page_id", whole.alias("whole"), F.when(whole, readers.folder_name(F.col("t"))).alias("name"))


@query("SELECT s_suppkey AS suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'NotoSansCJKsc-Regular.ttf' WHEN 1 THEN 'Symbola-Regular.ttf' ELSE CASE WHEN s_nationkey % 2 = 0 THEN 'NotoSerif' ELSE 'NotoSans' END || CASE WHEN s_nationkey % 5 = 0 AND s_suppkey % 7 = 0 THEN '-BoldItalic' WHEN s_nationkey % 5 = 0 THEN '-Bold' WHEN s_suppkey % 7 = 0 THEN '-Italic' ELSE '-Regular' END || '.ttf' END AS font FROM supplier")
def run_fonts(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    script = F.when(k % 3 == 0, "cjk").when(k % 3 == 1, "symbol").otherwise("latin")
    return table(spark, sf, "supplier").select(k.alias("suppkey"), readers.font_for(script, n % 2 == 0, n % 5 == 0, k % 7 == 0).alias("font"))


def packed(spark, sf):
    """(path, content): compiled books of the headwords of a hundred documents each, a paragraph for each between a title and an end."""
    group = F.expr("id div 100")
    words_of = heads(spark, sf).groupBy(group.alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x.word).alias("words"))

    def run(batches):
        for batch in batches:
            out = []
            for title, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, entries = f"<h1>{title}</h1>".encode(), []
                for w in own:
                    part = f"<p>{w}</p>".encode()
                    entries.append((w, len(text), len(part)))
                    text += part
                out.append(pack.book(text + b"<hr/>", entries, 1 + title % 2, title=f"B{title}", block=4096))
            yield pa.RecordBatch.from_arrays([pa.array([f"b{t}" for t in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return stage(words_of.mapInArrow(run, "path string, content binary"), "packed")


def _titled(files, what, *columns):
    return books.scan(files, what).join(books.scan(files, "books").select("book_id", "title"), "book_id").select("title", *columns)


SQL_PACKED = f"""{ASKED}, p AS (SELECT id // 100 AS g, id, word, '<p>' || word || '</p>' AS part FROM heads),
e AS (SELECT 'B' || g AS title, g, (row_number() OVER (PARTITION BY g ORDER BY id) - 1)::BIGINT AS id, word, part,
  (strlen('<h1>' || g || '</h1>') + coalesce(sum(strlen(part)) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM p),
t AS (SELECT title, g, '<h1>' || g || '</h1>' || string_agg(part, '' ORDER BY id) || '<hr/>' AS text, count(*)::BIGINT AS n, max(s + strlen(part))::BIGINT AS last FROM e GROUP BY 1, 2)"""


@query(f"{SQL_PACKED} SELECT title, id, word AS headword, s AS \"start\", s + strlen(part)::BIGINT AS \"end\" FROM e")
def packed_entries(spark, sf):
    return _titled(packed(spark, sf), "entries", "id", "headword", "start", "end")


@query(f"{SQL_PACKED} SELECT title, strlen(text)::BIGINT AS text_bytes, sha256(text) AS text_sha, 1::BIGINT + g % 2 AS compression FROM t")
def packed_texts(spark, sf):
    files = packed(spark, sf)
    facts = books.scan(files, "books").select("book_id", "title", "compression", "text_bytes")
    return books.scan(files, "texts").join(facts, "book_id").select("title", "text_bytes", F.sha2("text", 256).alias("text_sha"), "compression")


@query(f"{SQL_PACKED} SELECT title, id, word || 's' AS word, 'plural' AS group_name FROM e")
def packed_forms(spark, sf):
    return _titled(packed(spark, sf), "aliases", "id", "word", "group_name")


@query(f"{SQL_PACKED} SELECT title, n AS id, 'supplement 1' AS headword, 0::BIGINT AS \"start\", strlen('<h1>' || g || '</h1>')::BIGINT AS \"end\" FROM t UNION ALL SELECT title, n + 1, 'supplement 2', last, strlen(text)::BIGINT FROM t")
def packed_supplements(spark, sf):
    files = packed(spark, sf)
    full = books.with_supplements(books.scan(files, "entries"), books.scan(files, "texts")).where("kind = 'supplement'")
    return full.join(books.scan(files, "books").select("book_id", "title"), "book_id").select("title", "id", "headword", "start", "end")


@query(f"{SQL_PACKED} SELECT title, CASE WHEN n < 0 THEN NULL ELSE 'text' END AS role, (strlen(text) + 4095)::BIGINT // 4096 AS n FROM t")
def packed_records(spark, sf):
    found = _titled(packed(spark, sf), "records", "role").where("role = 'text'")
    return found.groupBy("title", "role").agg(F.count(F.lit(1)).alias("n"))
