"""Vectors and properties of the pure kernels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.functions import book_kernel as bk
from glossa.functions import css_kernel as css
from glossa.functions import html_kernel as html
from glossa.functions import readers, urls
from glossa.functions import stardict_kernel as sd


@pytest.mark.parametrize(("data", "value"), [(b"\x81", 1), (b"\x01\x80", 128), (b"\x0f\x7f\x7f\x7f\xff", 2**32 - 1)])
def test_variable_integers(data, value):
    assert bk.vint(data, 0) == (value, len(data))


@pytest.mark.parametrize("data", [b"\x10\x7f\x7f\x7f\xff", b"\0\0\0", b""])
def test_bad_variable_integers(data):
    with pytest.raises(bk.BookError):
        bk.vint(data, 0)


def test_palmdoc_vectors():
    assert bk.palmdoc(b"a\x80\x0b", 100) == b"aaaaaaa"
    assert bk.palmdoc(b"\xc1\x02\x01\x02z", 100) == b" A\x01\x02z"
    for bad in (b"\x80", b"\x80\x0b", b"\x05ab"):
        with pytest.raises(bk.BookError):
            bk.palmdoc(bad, 100)
    with pytest.raises(bk.BookError):
        bk.palmdoc(b"abc", 2)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_palmdoc_round_trip(data):
    assert bk.palmdoc(bk.pack_palmdoc(data), len(data)) == data


@pytest.mark.parametrize(("base", "program", "out"), [(b"cat", b"\x02s", b"cats"), (b"do", b"\x01un", b"undo"), (b"city", b"\x03y\x02sei", b"cities"), (b"undo", b"\x04un", b"do")])
def test_edit_programs(base, program, out):
    assert bk.edit_word(base, program) == out


@pytest.mark.parametrize(("base", "program"), [(b"cat", b"\x03x"), (b"a", b"\x03a"), (b"a", b"\x00b")])
def test_bad_edit_programs(base, program):
    with pytest.raises(bk.BookError):
        bk.edit_word(base, program)


def test_trailers():
    assert bk.strip_trailers(b"text\x81", 2) == b"text"
    assert bk.strip_trailers(b"textxx\x83", 2) == b"text"
    assert bk.strip_trailers(b"text\x00", 1) == b"text"
    with pytest.raises(bk.BookError):
        bk.strip_trailers(b"\xff", 2)


def test_huff_literals_and_cycles():
    import struct

    def table(n_bits=8):
        quick = b"".join(struct.pack(">I", (255 << 8) | 0x80 | n_bits) for _ in range(256))
        limits = struct.pack(">64I", *([0, 0] * 32))
        return b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + b"\0" * 8 + quick + limits

    def phrases(items):
        offs, body = [], b""
        for text, literal in items:
            offs.append(2 * len(items) + len(body))
            body += struct.pack(">H", len(text) | (0x8000 if literal else 0)) + text
        return b"CDIC" + struct.pack(">III", 16, len(items), 8) + struct.pack(f">{len(items)}H", *offs) + body

    plain = bk.Huff(table(), [phrases([(b"lo", True), (b"hel", True)])])
    assert plain.decompress(bytes([254, 255]), 100, [10]) == b"hello"
    nested = bk.Huff(table(), [phrases([(bytes([254]), False), (b"x", True)])])
    assert nested.decompress(bytes([255]), 100, [10]) == b"x"
    with pytest.raises(bk.BookError):
        bk.Huff(table(), [phrases([(bytes([255]), False)])]).decompress(bytes([255]), 100, [100])
    with pytest.raises(bk.BookError):
        plain.decompress(bytes([254, 255]), 100, [1])


def test_tokenizer_spans():
    data = b"<a href='x>y' id=b>t</a><!-- <i> --><style>p{<}</style><br/>"
    got = [(t.kind, t.name, t.closing, data[t.start : t.end]) for t in html.tokens(data)]
    assert got == [("tag", "a", False, b"<a href='x>y' id=b>"), ("tag", "a", True, b"</a>"), ("opaque", "", False, b"<!-- <i> -->"), ("tag", "style", False, b"<style>"), ("raw", "style", False, b"p{<}"), ("tag", "style", True, b"</style>"), ("tag", "br", False, b"<br/>")]


@pytest.mark.parametrize("bad", [b"<a", b"<a x=1 x=2>", b"</a x>", b"<!-- ", b"<!DOCTYPE [>", b"<style>p", b'<a b="c>', b"<a =b>", b"<a b=>"])
def test_tokenizer_is_strict(bad):
    with pytest.raises(html.HtmlError):
        list(html.tokens(bad))


def test_text_and_entities():
    assert html.plain_text("caf&eacute; <b>A</b>&nbsp; B<style>x</style>".encode()) == "café A B"
    assert html.decode_attribute("a&amp;b&#65;&x") == "a&bA&x"
    with pytest.raises(html.HtmlError):
        html.decode_attribute("&eacute;")
    assert html.anchors(b"<a name=x><p id='y'></p></a>") == ["x", "y"]
    assert html.stylesheets(b"<link rel=stylesheet href=a.css><link rel=icon href=b>") == ["a.css"]
    assert html.wrap_characters("a中&#20013;b<i>中</i>".encode(), lambda c: ord(c) > 0x3000, "<b>", "</b>").decode() == "a<b>中&#20013;</b>b<i><b>中</b></i>"
    assert html.sanitize(b"<p>a<script>x()</script><a ping=b href=c>d</a></p>") == b"<p>a<a  href=c>d</a></p>"
    assert html.inline_images(b"<img src='a.png'><img src=b>", {"a.png": "data:x"}) == b"<img src='data:x'><img src=b>"


def test_replay():
    assert html.replay(b"abcdef", [(1, 2, b"X"), (2, 2, b"Y"), (4, 6, b"")]) == b"aXYcd"
    assert html.replay(b"abcdef", [(1, 2, b"X"), (4, 5, b"Z")], 3, 6) == b"dZf"
    with pytest.raises(html.HtmlError):
        html.replay(b"abcdef", [(1, 3, b""), (2, 4, b"")])


def test_css():
    assert css.scope("body { color:red } .entry,b{font-weight:bold}", "d") == ".d{ color:red }.d .entry,.d b{font-weight:bold}"
    assert css.scope('html > body p, a:is(b,c)[x="],"]{x:y}', "d", False) == '.d p,.d a:is(b,c)[x="],"]{x:y}'
    assert css.scope("body > p{x:y}", "d", False) == ".d > p{x:y}"
    assert css.scope("@media print{i{k:v}} @font-face{src:x}", "d", False) == "@media print{.d i{k:v}}@font-face{src:x}"
    assert css.scope("a{b:c", "d", False) == ".d a{b:c}"
    for bad in ("a{b:c", "@import 'x';", "a:hover{}", "/* a", ",a{}", "a}"):
        with pytest.raises(css.CssError):
            css.scope(bad, "d")
    assert css.unsafe("a{b: u rl (x)}") == "url("
    assert css.isolate("body p, a{x:y}", "1") == "#gd-1 p, #gd-1 a {x:y}"


def test_readers():
    assert readers.fold("Éclair-s") == "eclairs"
    assert readers.spellings("éa") == ["éa", "Éa", "ÉA", "éa", "ea"]
    assert [readers.group_key(w) for w in ("run", "a", "", "日本", "ひら", "до", "1a", "a-", " x")] == ["ru", "aa", "11", "日", "ヒラ", "до", "11", "11", "xa"]
    assert [readers.folder(t) for t in ("a/b:c", "con", "CON.txt", "...", "x" * 200)] == ["a b c", "_con", "_CON.txt", "Dictionary", "x" * 120]
    assert len(readers.chapter("[Chapter 000001] ", "é" * 300).encode()) < 250


def test_relative_paths():
    assert urls.relative("a/b.x", "a/c.x") == "c.x"
    assert urls.relative("a/b/c.x", "d e.x") == "../../d%20e.x"
    assert urls.decode_lenient("%zz%ff") == "%zz�"
    with pytest.raises(ValueError):
        urls.decode_strict("%z")


def test_dictionary_format_is_checked():
    idx = sd.index_record("a", 0, 2) + sd.index_record("B", 2, 3)
    ifo = f"{sd.MAGIC}\nversion=3.0.0\nwordcount=2\nidxfilesize={len(idx)}\nsametypesequence=h\n".encode()
    assert sd.parse(ifo, idx, b"", 5).entries == [("a", 0, 2), ("B", 2, 3)]
    for wrong in ((ifo, idx, b"", 6), (ifo, idx[:-1], b"", 5), (ifo, sd.index_record("B", 0, 2) + sd.index_record("a", 2, 3), b"", 5), (ifo, idx, sd.synonym_record("x", 9), 5)):
        with pytest.raises(sd.FormatError):
            sd.parse(*wrong)


@pytest.mark.parametrize(("base", "program", "out"), [(b"run", b"s", b"runs"), (b"run", b"gnin", b"running"), (b"walk", b"\x0cx", b"waxlk"), (b"walks", b"\x03s", b"walk"), (b"lied", b"\x04l\x01", b"ied")])
def test_edit_programs_begin_with_insertion_at_the_end(base, program, out):
    assert bk.edit_word(base, program) == out


def test_fold_lowers_each_character_alone():
    from glossa.functions.readers import fold

    assert fold("ΟΔΟΣ") == fold("οδοσ") == "οδοσ" and fold("Ärger-nis 2") == "argernis2"
