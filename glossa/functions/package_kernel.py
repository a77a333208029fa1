"""Source packages: archives of XHTML pages with dictionary markup, and their package file.

Pages are scanned with an XML parser that reports byte positions; every fact
(definition, headword, form, anchor, link, image, stylesheet) carries the span
it came from, counted from the file's first byte.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from typing import NamedTuple
from xml.parsers import expat

from glossa.functions import css_kernel
from glossa.functions.urls import decode_strict

MAX_FILES, MAX_DEPTH, MAX_EVENTS = 10_000, 256, 200_000
#: Elements and attributes that a page may not have.
FORBIDDEN = frozenset(["script", "iframe", "object", "embed", "audio", "video", "svg", "math", "base", "form", "style"])
DICTIONARY = frozenset(["idx:entry", "idx:orth", "idx:infl", "idx:iform"])
ACTIVE = frozenset(["srcset", "background", "xml:base"])
EXTERNAL = ("http:", "https:", "mailto:")


class PackageError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def path_ok(path: str) -> bool:
    parts = path.split("/")
    odd = any(p in ("", ".", "..") or p[-1] in ". " for p in parts)
    return len(path.encode()) <= 4096 and len(parts) <= 64 and not odd and not re.search(r"[\\:]", path) and not any(unicodedata.category(c) == "Cc" for c in path)


def members(data: bytes, budget: int) -> dict[str, bytes]:
    """Files of a plain archive by path; sizes are summed before anything is inflated, and colliding names refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > MAX_FILES or sum(i.file_size for i in infos) > budget:
                raise PackageError("LIMIT", "members or inflated size")
            seen: dict[str, str] = {}
            for i in infos:
                if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise PackageError("UNSUPPORTED", "encrypted member or compression")
                if not path_ok(i.filename):
                    raise PackageError("MALFORMED", f"path {i.filename!r}")
                parts = i.filename.split("/")
                for n in range(1, len(parts) + 1):
                    spelled = "/".join(parts[:n])
                    kind = spelled if n == len(parts) else spelled + "/"
                    key = unicodedata.normalize("NFD", spelled).lower()
                    if seen.setdefault(key, kind) != kind or (n == len(parts) and sum(j.filename == spelled for j in infos) > 1):
                        raise PackageError("MALFORMED", f"colliding path {spelled!r}")
            return {i.filename: z.read(i) for i in sorted(infos, key=lambda i: i.filename.encode())}
    except (zipfile.BadZipFile, zlib.error, NotImplementedError) as e:
        raise PackageError("MALFORMED", str(e)) from e


def resolve(file: str, url: str) -> tuple[str, str] | None:
    """(file, anchor) that a reference leads to; None for an external one."""
    if url.lower().startswith(EXTERNAL):
        return None
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|/", url) or re.search(r"[?\\]", url):
        raise PackageError("UNSUPPORTED", f"reference {url!r}")
    path, _, anchor = url.partition("#")
    try:
        path, anchor = decode_strict(path), decode_strict(anchor)
    except ValueError as e:
        raise PackageError("MALFORMED", f"reference {url!r}") from e
    if not path:
        return file, anchor
    parts = file.split("/")[:-1]
    for p in path.split("/"):
        if p == "..":
            if not parts:
                raise PackageError("MALFORMED", f"reference {url!r} leaves the package")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    target = "/".join(parts)
    if not path_ok(target):
        raise PackageError("MALFORMED", f"reference {url!r}")
    return target, anchor


class Fact(NamedTuple):
    """One thing a page says. ``entry`` and ``orth`` count within the page, from 0."""

    kind: str
    start: int
    end: int
    name: str | None = None
    value: str | None = None
    entry: int | None = None
    orth: int | None = None
    target: str | None = None
    anchor: str | None = None


class _Page:
    def __init__(self, file: str, data: bytes):
        self.file, self.data, self.facts = file, data, []
        self.stack: list[list] = []
        self.title, self.entries, self.orths, self.roots = [], 0, 0, 0
        self.body = self.body_tag = self.head_end = None
        self.open: dict[int, int] = {}
        p = self.parser = expat.ParserCreate()
        p.buffer_text, p.ordered_attributes = False, False
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.begin, self.end, self.text
        p.ProcessingInstructionHandler = lambda *_: self.fail("UNSUPPORTED", "processing instruction")
        p.StartDoctypeDeclHandler = lambda _n, _s, _p, subset: self.fail("UNSUPPORTED", "internal subset") if subset else None
        p.UseForeignDTD(True)
        p.ExternalEntityRefHandler = lambda *_: 1
        p.SkippedEntityHandler = self.skipped

    def fail(self, code: str, message: str):
        raise PackageError(code, f"{self.file}: {message}")

    def tag_end(self, at: int) -> int:
        quote = None
        for i in range(at, len(self.data)):
            c = self.data[i]
            if quote:
                quote = None if c == quote else quote
            elif c in b"\"'":
                quote = c
            elif c == 62:
                return i + 1
        self.fail("MALFORMED", "unclosed tag")

    def begin(self, name: str, attrs: dict[str, str]):
        at = self.parser.CurrentByteIndex
        end = self.tag_end(at)
        if name != name.lower():
            self.fail("UNSUPPORTED", "mixed-case element")
        if not self.stack and (name != "html" or self.roots):
            self.fail("MALFORMED", "root element")
        self.roots += not self.stack
        if len(self.stack) >= MAX_DEPTH:
            self.fail("LIMIT", "depth")
        if name in FORBIDDEN or (name.startswith("idx:") and name not in DICTIONARY):
            self.fail("UNSUPPORTED", f"element {name}")
        if any(k.lower().startswith("on") or k in ACTIVE for k in attrs) or css_kernel.unsafe(attrs.get("style", ""), False):
            self.fail("UNSUPPORTED", "active attribute or style")
        if name == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            self.fail("UNSUPPORTED", "refresh")
        entry = next((f[1] for f in reversed(self.stack) if f[1] is not None), None)
        orth = next((f[2] for f in reversed(self.stack) if f[2] is not None), None)
        mine = own_orth = None
        if name == "body":
            if self.body:
                self.fail("MALFORMED", "second body")
            self.body, self.body_tag = [end, None], (at, end)
        elif name == "idx:entry":
            if not self.body or self.body[1] is not None:
                self.fail("MALFORMED", "entry outside the body")
            mine, entry, self.entries = self.entries, self.entries, self.entries + 1
            above = "\x1f".join(f"{f[0]}\x1e{f[3]}\x1e{f[4]}" for f in self.stack if f[0] not in ("html", "head", "body", "idx:entry"))
            self.open[len(self.stack)] = len(self.facts)
            self.facts.append(Fact("definition", at, end, value=above, entry=mine))
        elif name == "idx:orth":
            if entry is None or "value" not in attrs:
                self.fail("MALFORMED", "headword outside an entry or without a value")
            own_orth, self.orths = self.orths, self.orths + 1
            self.open[len(self.stack)] = len(self.facts)
            self.facts.append(Fact("orth", at, end, value=attrs["value"], entry=entry, orth=own_orth))
        elif name == "idx:iform":
            if orth is None or "value" not in attrs:
                self.fail("MALFORMED", "form outside a headword or without a value")
            self.facts.append(Fact("form", at, end, name=attrs.get("name"), value=attrs["value"], entry=entry, orth=orth))
        elif name == "img":
            self.reference("image", at, end, attrs.get("src"))
        elif name == "link":
            if attrs.get("rel") != "stylesheet":
                self.fail("UNSUPPORTED", "link relation")
            self.reference("stylesheet", at, end, attrs.get("href"))
        for anchor in dict.fromkeys([attrs.get("id"), attrs.get("name") if name == "a" else None]):
            if anchor:
                self.facts.append(Fact("anchor", at, end, name=anchor, entry=entry))
        if name == "a" and "href" in attrs:
            self.reference("link", at, end, attrs["href"])
        self.stack.append([name, mine, own_orth, at, end])

    def reference(self, kind: str, at: int, end: int, url: str | None):
        if not url:
            self.fail("MALFORMED", f"{kind} without an address")
        target = resolve(self.file, url)
        if target is None and kind != "link":
            self.fail("UNSUPPORTED", f"external {kind}")
        file, anchor = target or (None, None)
        self.facts.append(Fact(kind, at, end, value=url, target=file, anchor=anchor or None))

    def end(self, name: str):
        at = self.parser.CurrentByteIndex
        self.stack.pop()
        stop = self.tag_end(at) if self.data[at : at + 2] == b"</" else at
        slot = self.open.pop(len(self.stack), None)
        if slot is not None:
            self.facts[slot] = self.facts[slot]._replace(end=max(stop, self.facts[slot].end))
        if name == "body":
            self.body[1] = at
        elif name == "head":
            self.head_end = at

    def text(self, data: str):
        if any(f[0] == "title" for f in self.stack):
            self.title.append(data)

    def skipped(self, name: str, _parameter):
        import html

        text = html.unescape(f"&{name};")
        if text == f"&{name};":
            self.fail("MALFORMED", f"reference &{name};")
        self.text(text)

    def run(self) -> tuple[dict, list[Fact]]:
        try:
            self.parser.Parse(self.data, True)
        except expat.ExpatError as e:
            self.fail("MALFORMED", str(e))
        if not self.body or self.body[1] is None or self.head_end is None:
            self.fail("MALFORMED", "incomplete page")
        page = {"title": "".join(self.title).strip(), "body_start": self.body[0], "body_end": self.body[1], "tag_start": self.body_tag[0], "tag_end": self.body_tag[1], "head_end": self.head_end}
        return page, self.facts


def page(file: str, data: bytes) -> tuple[dict, list[Fact]]:
    """What an XHTML page says, with byte spans."""
    try:
        data.decode()
    except UnicodeDecodeError as e:
        raise PackageError("MALFORMED", f"{file}: {e}") from e
    return _Page(file, data).run()


MEDIA = frozenset(["application/xhtml+xml", "text/html", "text/css", "image/png", "image/jpeg", "image/gif", "image/bmp", "text/x-oeb1-document", "application/x-dtbncx+xml"])


def package(file: str, data: bytes) -> dict:
    """Title, manifest (id -> file, media type) and reading order of a package file."""
    out: dict = {"title": "", "manifest": {}, "spine": []}
    events, inside = [0], []

    def begin(name, attrs):
        events[0] += 1
        if events[0] > MAX_EVENTS:
            raise PackageError("LIMIT", "package events")
        local = name.split(":")[-1].lower()
        inside.append(local)
        if local == "item":
            if attrs.get("media-type") not in MEDIA:
                raise PackageError("UNSUPPORTED", f"media type {attrs.get('media-type')}")
            target = resolve(file, attrs.get("href", ""))
            if target is None or attrs.get("id") in out["manifest"]:
                raise PackageError("MALFORMED", "manifest item")
            out["manifest"][attrs["id"]] = (target[0], attrs["media-type"])
        elif local == "itemref":
            out["spine"].append(attrs.get("idref"))

    def text(t):
        if inside and inside[-1] == "title":
            out["title"] += t

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = begin, lambda _n: inside.pop(), text
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise PackageError("MALFORMED", str(e)) from e
    if not out["spine"] or len(set(out["spine"])) != len(out["spine"]) or any(i not in out["manifest"] for i in out["spine"]):
        raise PackageError("INCOMPLETE", "reading order")
    out["title"] = out["title"].strip()
    return out
