"""Compiled books, source packages and dictionaries, from bytes to tables and back."""

import struct

import pytest
from pyspark.sql import functions as F

from glossa.functions import book_kernel as bk
from glossa.functions import package_kernel as pk
from glossa.operators import catalog, crosscheck
from glossa.operators.rejects import CheckFailed
from glossa.plans import convert
from glossa.sources import books, packages, stardict
from glossa.streaming import exact_stream
from tests import book_writer as w

REED_TEXT, FORET_TEXT = "<dt>reed</dt> stands in water".encode(), "<dt>forêt</dt> stands in leaves".encode()
TEXT = b"<h2>Wet and dry</h2>" + REED_TEXT + FORET_TEXT + b"<h2>Here the words are over, and a colophon of some length is decoded</h2>"
REED, FORET = ((TEXT.index(t), len(t)) for t in (REED_TEXT, FORET_TEXT))
ENTRIES = [("reed", *REED), ("rush", REED[0], 0), ("forêt", *FORET)]
PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 20


def frame(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


@pytest.mark.parametrize("compression", [1, 2])
def test_compiled_book(spark, compression):
    files = frame(spark, w.book(TEXT, ENTRIES, compression, [PNG]))
    head = books.scan(files, "books").first()
    assert (head.title, head.compression, head.text_bytes, head.refused) == ("A Book", compression, len(TEXT), None)
    assert bytes(books.scan(files, "texts").first().text) == TEXT
    entries = books.scan(files, "entries")
    assert [(r.headword, r.start, r.end) for r in entries.orderBy("id").collect()] == [("reed", REED[0], sum(REED)), ("rush", REED[0], sum(REED)), ("forêt", FORET[0], sum(FORET))]
    assert [(r.id, r.word, r.group_name) for r in books.scan(files, "aliases").orderBy("id").collect()] == [(0, "reeds", "plural"), (1, "rushs", "plural"), (2, "forêts", "plural")]
    full = books.with_supplements(entries, books.scan(files, "texts")).where("kind = 'supplement'").orderBy("id").collect()
    assert [(r.id, r.headword, r.start, r.end) for r in full] == [(3, "supplement 1", 0, REED[0]), (4, "supplement 2", sum(FORET), len(TEXT))]
    assert [(r.recindex, r.file, r.media_type) for r in books.scan(files, "resources").collect()] == [(1, "image-000001.png", "image/png")]
    roles = [r.role for r in books.scan(files, "records").orderBy("record").collect()]
    assert roles[:2] == ["header", "text"] and "orth_index" in roles and "infl_index" in roles and roles[-1] == "image"
    assert sum(r.decoded_bytes for r in books.scan(files, "text_records").collect()) == len(TEXT)
    assert books.scan(files, "errors").count() == 0


def test_broken_books(spark):
    good = bytearray(w.book(TEXT, ENTRIES))
    at = struct.unpack_from(">I", good, 78)[0]
    drm, old = bytearray(good), bytearray(good)
    struct.pack_into(">H", drm, at + 12, 1)
    struct.pack_into(">I", old, at + 36, 4)
    files = frame(spark, bytes(drm), bytes(old), bytes(good[:200]), b"", w.book(TEXT, [("x", 0, 0)]), w.book(TEXT, [("x", 0, 10**6)]))
    codes = {r.code for r in books.scan(files, "errors").collect()}
    assert codes == {"UNSUPPORTED", "MALFORMED", "INCOMPLETE"} and books.scan(files, "errors").count() == 6
    assert books.scan(files, "entries").count() == 0
    assert sorted(r.refused for r in books.scan(frame(spark, bytes(drm), bytes(old)), "books").collect()) == ["encrypted", "version 4"]


def test_old_inflections():
    idx = bk.Index([*w.index([w.row(b"ies", b"\x01", 1, 0), w.row(b"s", b"\x01", 0, 1)], [(7, 2, 1, 0), (0, 0, 0, 1)], [b"y"])], 0)
    suffixes = bk.old_suffixes(idx)
    assert bk.old_aliases(b"city", suffixes, 1) == [b"citys", b"cities"] and bk.old_aliases(b"", suffixes, 1) == [b"s"]


def test_tags():
    described = [(1, 1, 1, 0), (2, 2, 6, 0), (3, 1, 8, 0), (0, 0, 0, 1)]
    assert bk.read_tags(b"\x0b" + w.vint(5) + w.vint(7) + w.vint(8) + w.vint(9), 0, 1, described) == ({1: [5], 2: [7, 8], 3: [9]}, 5)
    assert bk.read_tags(b"\x06" + w.vint(4) + w.vint(1) * 4, 0, 1, described)[0] == {2: [1, 1, 1, 1]}
    for bad in (b"\x10", b"\x06" + w.vint(1) + w.vint(1)):
        with pytest.raises(bk.BookError):
            bk.read_tags(bad, 0, 1, described)


def test_package_tables(spark):
    package = packages.files(frame(spark, w.package()))
    t = packages.book(package)
    words = {r.id: r.value for r in t["orth"].collect()}
    assert sorted(words.values()) == ["forêt", "moor", "moss"]
    assert [(r.value, words[r.orth_id], r.name) for r in t["form"].collect()] == [("mosses", "moss", "several")]
    assert {r.name for r in t["anchor"].collect()} >= {"m-2", "f-2"}
    pages = {r.title: r for r in t["page"].collect()}
    assert set(pages) == {"Moss < moor", "F"}
    for title, source in (("Moss < moor", w.M_PAGE), ("F", w.F_PAGE)):
        raw, page = source.encode(), pages[title]
        assert raw[page.tag_start : page.tag_end].startswith(b"<body") and raw[page.body_end :].startswith(b"</body>")
    ends = {(raw[r.start : r.start + 11], raw[r.end - 12 : r.end]) for r in t["definition"].collect() for raw in [w.FILES[r.file].encode()]}
    assert t["definition"].count() == 3 and ends == {(b"<idx:entry>", b"</idx:entry>")}
    assert [(r.file, r.pos) for r in packages.spine(package).orderBy("pos").collect()] == [("wet/words/m.xhtml", 0), ("wet/words/f.xhtml", 1)]
    assert {r.title for r in packages.spine(package).collect()} == {"Wet Ground"}
    assert packages.reference_failures(package, t).count() == 0
    for gone, code in (({"wet/look/moss.png": None}, "INCOMPLETE"), ({"wet/words/f.xhtml": w.F_PAGE.replace('id="f-1"', 'id="f-9"')}, "INCOMPLETE")):
        broken = packages.files(frame(spark, w.package(gone)))
        assert {r.code for r in packages.reference_failures(broken, packages.book(broken)).collect()} == {code}


@pytest.mark.parametrize("bad", [b"<html><body></html>", b"<html><head/><body><script/></body></html>", b"<html><head/><body onload='x'/></html>", b"<html><head/><body><idx:orth value='x'/></body></html>", b"<!DOCTYPE a [<!ENTITY b 'c'>]><html><head/><body/></html>", b"\xff", b"<HTML/>"])
def test_pages_are_strict(bad):
    with pytest.raises(pk.PackageError):
        pk.page("a.html", bad)


def test_package_paths_and_references():
    assert [pk.path_ok(p) for p in ("a/b", "../a", "a//b", "a:b", "a.", "a/b ")] == [True, False, False, False, False, False]
    assert pk.resolve("x/p.html", "../q.html#a") == ("q.html", "a") and pk.resolve("p.html", "mailto:x") is None
    for bad in ("../x", "/a", "a?b", "ftp:x", "%zz"):
        with pytest.raises(pk.PackageError):
            pk.resolve("p.html", bad)
    with pytest.raises(pk.PackageError):
        pk.members(w.package({"wet/words/M.xhtml": "x"}), 1 << 20)
    with pytest.raises(pk.PackageError):
        pk.members(w.package(), 10)


@pytest.mark.parametrize("content", [w.book(TEXT, ENTRIES), w.package()])
def test_conversion_round_trip(spark, tmp_path, content):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one").write_bytes(content)
    out = str(tmp_path / "out")
    counts = convert.convert(spark, str(tmp_path / "in"), out).first()
    compiled = content[:4] != b"PK\x03\x04"
    plural, base = ("reeds", "reed") if compiled else ("mosses", "moss")
    assert (counts.entries, counts.synonyms) == ((5, 3 + 5) if compiled else (3, 1))  # forms, and a generated key of each entry
    assert [(r.query, r.word) for r in convert.look_up(spark, out, [plural, "nothing"]).collect()] == [(plural, base)]
    assert {r.word for r in convert.look_up(spark, out, ["FORET"], "goldendict-ng").collect()} == {"forêt"}
    stardict.register(spark)
    got = spark.read.format("stardict").load(out)
    assert got.count() == counts.entries and spark.read.format("stardict").option("table", "synonyms").load(out).count() == counts.synonyms
    book = next((tmp_path / "out").iterdir())
    data = bytearray((book / "dictionary.dict").read_bytes())
    data[0] ^= 1
    (book / "dictionary.dict").write_bytes(bytes(data))
    (book / ".dictionary.dict.crc").unlink(missing_ok=True)
    items = spark.createDataFrame([(book.name, "x", bytearray(b"y"))], "book_id string, word string, payload binary")
    assert convert.verify(spark, out, items).count() > 0


def test_books_of_one_folder_are_looked_up_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, word in enumerate(("alpha", "gamma")):
        text = f"<p>{word}</p>".encode()
        (tmp_path / f"in/{i}").write_bytes(w.book(text, [(word, 0, len(text))]))
    out = str(tmp_path / "out")
    convert.convert(spark, str(tmp_path / "in"), out)
    assert [r.word for r in convert.look_up(spark, out, ["alpha"]).collect()] == ["alpha"]
    hits = convert.look_up(spark, out, ["ALPHA", "gammas"], "goldendict-ng").collect()
    assert sorted((r["query"], r.word) for r in hits) == [("ALPHA", "alpha"), ("gammas", "gamma")] and len({r.book_id for r in hits}) == 2


def test_links_and_images_of_a_compiled_book(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ivy = b"<p>ivy climbs an <a href='#elm-1'>elm</a> <img recindex='00001'/></p>"
    at = len(ivy)
    elm = f"<p id='elm-1'>elm</p> <a filepos={0:010d}>ivy</a> and <a filepos={at:010d}>itself</a>".encode()
    (tmp_path / "in/b").write_bytes(w.book(ivy + elm, [("ivy", 0, at), ("elm", at, len(elm))], images=[PNG]))
    out = tmp_path / "out"
    counts = convert.convert(spark, str(tmp_path / "in"), str(out)).first()
    assert (counts.entries, counts.synonyms) == (2, 2 + 2 + 2)  # forms, generated keys, keys of two targets
    book = next(out.iterdir())
    assert (book / "res/image-000001.png").read_bytes() == PNG and [p.name for p in (book / "res").iterdir() if not p.name.startswith(".")] == ["image-000001.png"]
    text = (book / "dictionary.dict").read_text()
    key = lambda n: f"__glossa_{book.name}_entry_{n:016x}"
    assert "<img src='image-000001.png'/>" in text and f"<a href='bword://{key(1)}#glo-pos-{at}'>elm</a>" in text and f"bword://{key(0)}#glo-pos-0>ivy" in text
    found = convert.look_up(spark, str(out), [key(0), f"{key(1)}#glo-pos-{at}", "elms"]).collect()
    assert sorted((r["query"], r.word) for r in found) == sorted([(key(0), "ivy"), (f"{key(1)}#glo-pos-{at}", "elm"), ("elms", "elm")])


def test_files_of_both_kinds_and_embedded_packages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    held = w.book(TEXT, ENTRIES, images=[PNG, b"SRCS" + bytes(12) + w.package({"wet/look/plain.css": "h3 {}"})])
    for name, content in (("a.zip", w.package()), ("b", w.book(TEXT, ENTRIES)), ("c", held)):
        (tmp_path / "in" / name).write_bytes(content)
    counts = sorted((r.entries, r.synonyms) for r in convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect())
    assert counts == [(3, 1), (3, 1), (5, 8)]
    with pytest.raises(CheckFailed):
        convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "none"), "srcs")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/c").write_bytes(held)
    both = [convert.convert(spark, str(tmp_path / "one"), str(tmp_path / kind), kind).first().entries for kind in ("srcs", "compiled")]
    assert both == [3, 5]


def test_a_link_without_a_target_refuses_the_book(spark, tmp_path):
    text = b"<p>a <a href='#gone'>link</a></p>"
    (tmp_path / "b").write_bytes(w.book(text, [("a", 0, len(text))]))
    with pytest.raises(CheckFailed) as e:
        convert.convert(spark, str(tmp_path), str(tmp_path / "out"))
    assert e.value.exit_code == 5


def test_conversion_refuses(spark, tmp_path):
    (tmp_path / "one").write_bytes(w.package({"wet/look/moss.png": None}))
    with pytest.raises(CheckFailed) as e:
        convert.convert(spark, str(tmp_path), str(tmp_path / "out"))
    assert e.value.exit_code == 5


def test_archives_of_dictionaries():
    files = {"d/x.ifo": b"a", "d/x.idx": b"b" * 100, "d/res/i.png": PNG}
    assert stardict.pack(files) == stardict.pack(dict(reversed(files.items()))) and stardict.unpack(stardict.pack(files), 10_000) == files
    for bad in ({"a": b""}, files | {"e.ifo": b""}):
        with pytest.raises(ValueError):
            stardict.unpack(stardict.pack(bad), 10_000)
    with pytest.raises(ValueError):
        stardict.unpack(stardict.pack(files), 100)


def test_crosscheck(spark):
    source = spark.createDataFrame([(1, 0, ["run", "race"]), (1, 1, ["café"])], "book_id long, pos long, words array<string>")
    compiled = spark.createDataFrame([(1, 5, 9, "race"), (1, 5, 9, "run"), (1, 20, 30, "cafe")], "book_id long, start long, end long, word string")
    pairs = crosscheck.definitions(source, compiled)
    assert [r.same for r in pairs.orderBy("k").collect()] == [True, False]
    words = lambda *ws: spark.createDataFrame([(1, x) for x in ws], "book_id long, word string")
    forms = spark.createDataFrame([], "book_id long, base string, word string")
    got = crosscheck.check(words("run", "café"), words("run", "cafe"), forms, forms, pairs)
    assert sorted((r.check, r.key) for r in got.collect()) == [("definition", "2"), ("headword", "cafe"), ("headword", "café")]
    edge = lambda *es: spark.createDataFrame(list(es), "book_id long, group long, rule long")
    assert crosscheck.reverse_rules(edge((1, 1, 2), (2, 1, 1)), edge((1, 1, 2))).count() == 0
    assert crosscheck.reverse_rules(edge((1, 1, 2)), edge((1, 1, 3))).count() == 2


def test_streamed_lookups(spark, tmp_path):
    entries = catalog.catalog(spark.createDataFrame([(0, "run"), (1, "café")], "id long, word string"))
    index = catalog.keys(entries, spark.createDataFrame([("runs", 1)], "word string, target long"))
    spark.createDataFrame([("run",), ("runs",), ("x",)], "query string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "q"))
    job = exact_stream(stream, index).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    assert sorted((r.query, r.ordinal) for r in spark.table("hits").select("query", F.col("ordinal")).collect()) == [("run", 1), ("runs", 1)]
