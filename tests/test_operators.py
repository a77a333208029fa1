"""Operators on small tables, against brute force and known cases."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import readers, urls, words
from glossa.operators import catalog, graph, intervals, lookup, markup, multiset, refs, rejects


def one(spark, expr, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'string'}" for n, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values[n] for n in names) or (1,)], schema).select(expr.alias("v")).first().v


def test_gaps(spark):
    spans = spark.createDataFrame([(1, 5, 20), (1, 8, 12), (1, 15, 25), (2, 0, 3)], "b long, start long, end long")
    bounds = spark.createDataFrame([(1, 30), (2, 3), (3, 4)], "b long, bound long")
    assert sorted(map(tuple, intervals.gaps(spans, bounds, "b").collect())) == [(1, 0, 5), (1, 25, 30), (3, 0, 4)]
    assert sorted(map(tuple, intervals.covered_length(spans, "b").collect())) == [(1, 20), (2, 3)]
    assert [tuple(r)[:3] for r in intervals.overlapping(spans, "b").orderBy("start").collect()] == [(1, 8, 12), (1, 15, 25)]


def test_owner_of_each_point(spark):
    rng = random.Random(4)
    spans = [(1, s := rng.randrange(2000), s + rng.choice((1, 3, 20, 300)), i) for i in range(300)]
    points = [(1, p) for p in range(0, 2200, 7)]
    got = intervals.owners(spark.createDataFrame(points, "b long, pos long"), spark.createDataFrame(spans, "b long, start long, end long, id long"), ["b"]).collect()
    for r in got:
        held = [(e - s, i) for _, s, e, i in spans if s <= r.pos < e]
        assert r.owner == (min(held)[1] if held else None)
    assert len(got) == len(points)


def test_tiling_and_order(spark):
    ranges = spark.createDataFrame([(1, 0, 3), (1, 3, 2), (1, 3, 2), (2, 1, 4)], "b long, offset long, size long")
    assert sorted(map(tuple, intervals.tiling(ranges, ["b"]).collect())) == [(1, 0, 5), (2, 1, 5)]
    ws = ["ä", "Z", "apple", "Apple", "Ä", "z"]
    got = catalog.catalog(spark.createDataFrame(list(enumerate(ws)), "id long, word string")).orderBy("ordinal").collect()
    assert [r.word for r in got] == ["Apple", "apple", "Z", "z", "Ä", "ä"] and [r.ordinal for r in got] == list(range(6))
    assert intervals.unsorted(spark.createDataFrame([(1, 0, "b"), (1, 1, "a")], "b long, p long, w string"), ["b"], "p", [F.col("w")]).first().n_bad == 1


def test_catalog_bytes(spark):
    items = spark.createDataFrame([(1, "run", "x"), (2, "running", "x"), (3, "run", "yy")], "id long, word string, payload string")
    ranges = {r.sha: (r.offset, r.size) for r in catalog.payload_ranges(items).collect()}
    assert sorted(ranges.values()) == [(0, 1), (1, 2)]
    entries = catalog.catalog(items)
    aliases = spark.createDataFrame([("runs", 1), ("runs", 3), ("zz", 9)], "word string, target_id long")
    assert [tuple(r) for r in catalog.synonym_order(catalog.synonyms(entries, aliases)).select("pos", "word", "target").orderBy("pos").collect()] == [(0, "runs", 0), (1, "runs", 1)]
    assert [r.word for r in catalog.dangling(entries, aliases).collect()] == ["zz"]
    rec = catalog.index_records(spark.createDataFrame([("a", 258, 3)], "word string, offset long, size long")).first().record
    assert bytes(rec) == b"a\0\0\0\x01\x02\0\0\0\x03"


@pytest.fixture(scope="module")
def sample(spark):
    items = spark.createDataFrame([(0, "Run"), (1, "run"), (2, "café"), (3, "cat"), (4, words.KEY_PREFIX + "0" * 64 + "_entry_" + "0" * 16)], "id long, word string")
    entries = catalog.catalog(items)
    aliases = spark.createDataFrame([("runs", 1), ("RAN", 1), ("route", 3)], "word string, target_id long")
    return entries, catalog.keys(entries, catalog.synonyms(entries, aliases))


def test_lookups(spark, sample):
    entries, index = sample
    word = {r.ordinal: r.word for r in entries.collect()}
    ask = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    hits = lambda df: sorted((r.query, word[r.ordinal]) for r in df.collect())
    assert hits(lookup.exact(ask("run", "runs", "cafe"), index)) == [("run", "run"), ("runs", "run")]
    assert hits(lookup.ascii_case(ask("RUN", "ran"), index)) == [("RUN", "Run"), ("RUN", "run"), ("ran", "run")]
    assert hits(lookup.folded(ask("CAFE"), index)) == [("CAFE", "café")]
    assert hits(lookup.lower_first(ask("rUN", "ROUTE"), index)) == [("ROUTE", "cat"), ("rUN", "Run")]
    assert [(r["rank"], word[r.ordinal]) for r in lookup.koreader(ask("Run"), index).orderBy("rank").collect()] == [(1, "Run"), (2, "run")]
    assert hits(lookup.readest(ask("café"), index)) == [("café", "café")]
    assert hits(lookup.goldendict_mobile(ask("run", "RUNS"), index)) == [("RUNS", "run"), ("run", "run")]
    assert [r.headword for r in lookup.kobo(ask("runs"), index, entries).collect()] == ["run"]
    assert hits(lookup.viewer(ask(" run ", "CAT"), index)) == [(" run ", "run"), ("CAT", "cat")]
    assert [r.word for r in lookup.suggest(spark.createDataFrame([("R",)], "prefix string"), index).orderBy("rank").collect()] == ["RAN", "route", "Run", "run", "runs"]
    assert [lookup.headword_at(entries, f).first().word for f in (0.0, 0.999)] == ["café", "run"]
    assert {r.app for r in lookup.search(ask("run"), index, entries).collect()} == {"koreader", "goldendict-ng", "goldendict-mobile", "readest", "kobo"}


def test_following_links(spark):
    rows = [("koreader", "#a"), ("koreader", "bword://run"), ("koreader", "http://x"), ("goldendict-ng", "bword://r%20n#x"), ("goldendict-ng", "#y"), ("readest", "#z"), ("readest", "bword://a"), ("readest", "https://a"), ("kobo", "a")]
    got = lookup.follow(spark.createDataFrame([(*r, ["a"]) for r in rows], "app string, href string, anchors array<string>")).collect()
    assert [(r.outcome.kind, r.outcome.word, r.outcome.id) for r in got] == [("anchor", None, None), ("lookup", "run", None), ("external", None, None), ("lookup", "r n", "x"), ("scroll", None, "y"), ("scroll", None, "z"), ("not_followed", None, None), ("external", None, None), ("unknown", None, None)]


def test_references(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1001), (1003, 9999)]
    got = {r.id: (r.root, r.depth) for r in refs.resolve_references(spark.createDataFrame(chain, "id long, ref long")).collect()}
    assert all(got[i] == (0, i) for i in range(300)) and all(got[i] == (None, None) for i in (1000, 1001, 1002, 1003))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 54
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_multisets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "w string") for xs in (["a", "a", "b", None], ["a", "b", "c", None]))
    diff = multiset.difference(a, b, ["w"])
    assert sorted(map(tuple, diff.collect())) == [("a", 2, 1), ("c", 0, 1)]
    assert tuple(multiset.totals(diff).first()) == (1, 1)
    lists = spark.createDataFrame([(0, ["a"]), (1, ["a"]), (2, ["b", "a"]), (3, ["a", "b"]), (4, [])], "p long, l array<string>")
    assert [r.set_id for r in multiset.style_sets(lists, "p", "l").orderBy("p").collect()] == [0, 0, 1, 2, 3]
    paths = spark.createDataFrame([("A/x",), ("a/y",), ("b",), ("b/c",)], "path string")
    assert [tuple(r) for r in multiset.path_collisions(paths).collect()] == [("a", 2)]
    assert [r.path for r in multiset.file_directory_clashes(paths).collect()] == ["b"]


def test_rejects(spark):
    df = spark.createDataFrame([(1, ""), (2, "ok")], "id long, w string")
    channel = rejects.failures(df, "key", F.col("id"), ~words.key_ok(F.col("w")), "MALFORMED", "bad key")
    assert [r.key for r in channel.collect()] == ["1"]
    with pytest.raises(rejects.CheckFailed) as e:
        rejects.require_none(channel)
    assert e.value.exit_code == 3
    rejects.require_none(channel.where("false"))


def test_expressions(spark):
    assert one(spark, words.image_type(F.col("b"))["ext"], b=b"\x89PNG\r\n\x1a\nxx") == "png"
    assert one(spark, words.be(F.col("b"), 1, 4), b=b"\0\0\0\x01\x02") == 258 and one(spark, words.be(F.col("b"), 3, 4), b=b"\0\0\0\x01\x02") is None
    assert one(spark, words.data_uri(F.lit("image/png"), F.col("b")), b=b"x" * 100).count("\n") == 0
    assert one(spark, words.escape_html(F.col("s")), s="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, words.label(F.lit("zh"), "supplement", F.lit(3))) == "补充 3"
    assert one(spark, urls.percent_decode(F.col("s")), s="a%20b+c") == "a b+c" and one(spark, urls.percent_decode(F.col("s")), s="%zz") is None
    assert one(spark, urls.percent_encode(F.col("s"), True), s="a/b ~*é") == "a/b%20~%2A%C3%A9"
    assert tuple(one(spark, urls.resolve(F.lit("x/y/p.html"), F.col("s")), s="../q.html#a%20b")) == ("internal", "x/q.html", "a b")
    assert [one(spark, urls.resolve(F.lit("p.html"), F.col("s")), s=s).kind for s in ("../q", "mailto:x", "a?b", "ftp:x", "#z")] == ["error", "external", "error", "error", "internal"]
    assert one(spark, urls.clean_path(F.col("s")), s="/a/./b/../../..//c") == "c"
    assert one(spark, urls.resource_path(F.col("s")), s="//res%2Fa.png") == "res/a.png" and one(spark, urls.resource_path(F.col("s")), s="data:x") is None
    assert [one(spark, urls.package_path_ok(F.col("s")), s=s) for s in ("a/b", "a/../b", "/a", "a\\b", "a./b")] == [True, False, False, False, False]
    assert tuple(one(spark, readers.popup_box(F.lit(1072), F.lit(1448), F.lit(20)))) == (854, 517, 36)
    assert one(spark, readers.kobo_definition(F.col("s")), s=' x <img src="a.png" alt=1> <br><BR>') == "x [Image: a.png] "


def test_markup(spark):
    docs = spark.createDataFrame([(1, "<p id=a>x</p>"), (2, "<p"), (3, None)], "id long, html string")
    got = markup.tokens(docs, "id", "html").orderBy("id", "seq").collect()
    assert [(r.id, r.kind, r.code) for r in got] == [(1, "tag", None), (1, "tag", None), (2, "error", "MALFORMED")]
    assert [r.code for r in markup.gate(spark.createDataFrame([(1, "<SCRIPT>"), (2, "<p onclick =x>"), (3, "<p>")], "id long, html string"), "id", "html").orderBy("id").collect()] == ["UNSUPPORTED", "UNSUPPORTED", None]
    edits = spark.createDataFrame([(b"abc", [(1, 2, b"X")])], "d binary, e array<struct<start:long,`end`:long,replacement:binary>>")
    assert bytes(edits.select(markup.replay("d", "e").alias("v")).first().v) == b"aXc"
