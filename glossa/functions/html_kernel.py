"""HTML kernels over bytes: a span tokenizer, entity decoding, edit replay, and rewriting of visible text.

The tokenizer is strict: it raises ``HtmlError`` where a lenient one guesses.
It is driven by one pattern for each construct, anchored where it may begin.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

NAME, QUOTED = rb"[^\s=>/'\"<]+", rb"\"[^\"]*\"|'[^']*'"
_START = re.compile(rb"<(?:!--|[!?]|/?[A-Za-z])")
_DECLARATION = re.compile(rb"<[!?](?:[^'\"\[>]|%s)*" % QUOTED)
_TAG = re.compile(rb"<(/?)([A-Za-z][A-Za-z0-9:_-]*)")
_END = re.compile(rb"\s*(/?>)")
_ATTRIBUTE = re.compile(rb"\s*(%s)(?:\s*=\s*(?:(\"[^\"]*\"|'[^']*')|([^\s>]*)))?" % NAME)
RAW_TEXT = ("style", "script", "title", "textarea")


class HtmlError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Attribute(NamedTuple):
    name: str
    start: int
    end: int
    value_start: int
    value_end: int


class Token(NamedTuple):
    """kind is tag, opaque (comment, declaration) or raw (text of a raw-text element)."""

    kind: str
    name: str
    closing: bool
    start: int
    end: int
    attrs: tuple[Attribute, ...] = ()


def _name(raw: bytes) -> str:
    if not raw.isascii():
        raise HtmlError("UNSUPPORTED", "a tag or attribute name beyond ASCII")
    return raw.decode().lower()


def _attributes(data: bytes, at: int, closing: bool) -> tuple[list[Attribute], int, bool]:
    attrs: list[Attribute] = []
    while True:
        if m := _END.match(data, at):
            return attrs, m.end(), m[1] == b"/>"
        m = _ATTRIBUTE.match(data, at)
        if not m:
            raise HtmlError("MALFORMED", "unclosed tag" if not data[at:].strip() else f"invalid attribute at byte {at}")
        if closing:
            raise HtmlError("MALFORMED", "attributes on a closing tag")
        name = _name(m[1])
        if any(a.name == name for a in attrs):
            raise HtmlError("MALFORMED", f"duplicate attribute {name}")
        lo = hi = -1
        if m[2] is not None:
            lo, hi = m.start(2) + 1, m.end(2) - 1
        elif m[3] is not None:
            lo, hi = m.span(3)
            if lo == hi or re.search(rb"[<'\"=`]", m[3]):
                raise HtmlError("MALFORMED", "empty, unclosed or invalid attribute value")
        attrs.append(Attribute(name, m.start(1), m.end(), lo, hi))
        at = m.end()


def tokens(data: bytes):
    """Tags, opaque spans and raw text, in order; what lies between them is text."""
    at = 0
    while m := _START.search(data, at):
        start = m.start()
        if m[0] == b"<!--":
            end = data.find(b"-->", start + 4)
            if end < 0:
                raise HtmlError("MALFORMED", "unclosed comment")
            at = end + 3
            yield Token("opaque", "", False, start, at)
        elif m[0][1:2] in b"!?":
            end = _DECLARATION.match(data, start).end()
            if data[end : end + 1] == b"[":
                raise HtmlError("UNSUPPORTED", "internal subsets and CDATA")
            if data[end : end + 1] != b">":
                raise HtmlError("MALFORMED", "unclosed declaration")
            at = end + 1
            yield Token("opaque", "", False, start, at)
        else:
            tag = _TAG.match(data, start)
            closing, name = bool(tag[1]), _name(tag[2])
            attrs, at, lone = _attributes(data, tag.end(), closing)
            yield Token("tag", name, closing, start, at, tuple(attrs))
            if name in RAW_TEXT and not closing and not lone:
                end = re.compile(rb"</%s[\s>]" % name.encode(), re.IGNORECASE).search(data, at)
                if not end:
                    raise HtmlError("MALFORMED", f"unclosed raw-text element {name}")
                if end.start() > at:
                    yield Token("raw", name, False, at, end.start())
                at = end.start()


_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|([A-Za-z][A-Za-z0-9]*));")
#: The named references of attributes.
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": "\xa0"}


def decode_attribute(text: str) -> str:
    """Six named references and numeric ones; an unknown name is an error, a bare ampersand stays."""

    def one(m: re.Match) -> str:
        if m[3]:
            if m[3] not in NAMED:
                raise HtmlError("UNSUPPORTED", f"reference &{m[3]};")
            return NAMED[m[3]]
        n = int(m[1]) if m[1] else int(m[2], 16)
        if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            raise HtmlError("MALFORMED", "reference to no character")
        return chr(n)

    return _REFERENCE.sub(one, text)


def decode_text(text: str) -> str:
    """HTML5 names and numeric references, which must end with a semicolon."""
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]), text)


def plain_text(data: bytes) -> str:
    """Text between tokens and raw text but for style and script, decoded, white space collapsed."""
    parts, at = [], 0
    for t in tokens(data):
        if t.kind == "raw" and t.name not in ("style", "script"):
            parts.append(data[at : t.end])
        else:
            parts.append(data[at : t.start])
        at = t.end
    parts.append(data[at:])
    return " ".join(decode_text(b"".join(parts).decode("utf-8", "replace")).split())


def anchors(data: bytes) -> list[str]:
    """Ids, and names of ``a`` elements, sorted and distinct."""
    found = set()
    for t in tokens(data):
        if t.kind == "tag" and not t.closing:
            found.update(decode_attribute(data[a.value_start : a.value_end].decode()) for a in t.attrs if a.value_start >= 0 and (a.name == "id" or (a.name == "name" and t.name == "a")))
    return sorted(found - {""})


def replay(data: bytes, edits: list[tuple[int, int, bytes]], lo: int = 0, hi: int | None = None) -> bytes:
    """The bytes [lo, hi) with sorted edits (start, end, replacement) applied; an edit across a border is an error."""
    hi = len(data) if hi is None else hi
    out, at = [], lo
    for start, end, new in edits:
        if end < lo or start > hi or (end == lo and start < lo):
            continue
        if start < at or end > hi:
            raise HtmlError("MALFORMED", "edits overlap or cross the border")
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:hi]])


def inline_images(data: bytes, images: dict[str, str]) -> bytes:
    """``src`` of images that the mapping knows, replaced by what it maps to."""
    edits = []
    for t in tokens(data):
        if t.kind == "tag" and t.name == "img" and not t.closing:
            for a in t.attrs:
                src = data[a.value_start : a.value_end].decode() if a.name == "src" and a.value_start >= 0 else None
                if src in images:
                    edits.append((a.value_start, a.value_end, images[src].encode()))
    return replay(data, edits)


def stylesheets(data: bytes) -> list[str]:
    """``href`` of linked stylesheets, in order."""
    out = []
    for t in tokens(data):
        if t.kind == "tag" and t.name == "link" and not t.closing:
            a = {x.name: data[x.value_start : x.value_end].decode() if x.value_start >= 0 else "" for x in t.attrs}
            if "stylesheet" in a.get("rel", "").lower().split() and a.get("href"):
                out.append(decode_attribute(a["href"]))
    return out


def wrap_characters(data: bytes, pick, before: str, after: str) -> bytes:
    """Runs of visible characters for which ``pick`` holds, wrapped; a reference counts as its character."""
    piece = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|.", re.DOTALL)
    edits: list[tuple[int, int, bytes]] = []

    def text(lo: int, hi: int) -> None:
        out, open_ = [], False
        for m in piece.finditer(data[lo:hi].decode("utf-8", "surrogateescape")):
            shown = html.unescape(m[0])
            hit = len(shown) == 1 and bool(pick(shown))
            if hit != open_:
                out.append(before if hit else after)
                open_ = hit
            out.append(m[0])
        out.append(after if open_ else "")
        edits.append((lo, hi, "".join(out).encode("utf-8", "surrogateescape")))

    at = 0
    for t in tokens(data):
        if t.start > at:
            text(at, t.start)
        at = t.end
    if at < len(data):
        text(at, len(data))
    return replay(data, edits)


#: Elements and attributes that are removed before display.
ACTIVE = ("meta", "base", "link", "script", "iframe", "frame", "frameset", "object", "embed")


def sanitize(data: bytes) -> bytes:
    edits, skip = [], None
    for t in tokens(data):
        if t.kind == "tag" and t.name in ACTIVE:
            edits.append((t.start, t.end, b""))
            skip = t.name
        elif t.kind == "raw" and t.name == skip == "script":
            edits.append((t.start, t.end, b""))
        elif t.kind == "tag":
            edits += [(a.start, a.end, b"") for a in t.attrs if a.name == "ping"]
    return replay(data, edits)
