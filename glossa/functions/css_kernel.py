"""CSS kernels: scoping of stylesheets below a class, in a strict and an error-recovering grammar."""

from __future__ import annotations

import re

MAX_DEPTH = 16
#: At-rules whose blocks hold descriptors and select nothing.
DESCRIPTORS = frozenset(["font-face", "page", "keyframes", "-webkit-keyframes", "-moz-keyframes", "counter-style"])
_STRING_OR_COMMENT = re.compile(r"(\"[^\"]*\"|'[^']*')|/\*.*?\*/|(/\*|[\"'])", re.DOTALL)
_PIECE = re.compile(r"\"[^\"]*\"|'[^']*'|[\[\](){};,]")
_SIMPLE = re.compile(r"[A-Za-z0-9\s_.#,-]+", re.ASCII)
_ROOT = re.compile(r"(?:html|body)(?=$|[\s>])\s*(>?)\s*", re.IGNORECASE)


class CssError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _without_comments(css: str, bounded: bool) -> str:
    out, at = [], 0
    for m in _STRING_OR_COMMENT.finditer(css):
        out.append(css[at : m.start()])
        at = m.end()
        if m[1]:
            out.append(m[1])
        elif m[2] == "/*" and not bounded:
            return "".join(out)
        elif m[2]:
            raise CssError("MALFORMED", "unclosed comment or string")
    return "".join([*out, css[at:]])


def _prelude_end(css: str, at: int) -> int | None:
    """Where the prelude's ``{`` or ``;`` is, outside strings and brackets."""
    depth = 0
    for m in _PIECE.finditer(css, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif depth == 0 and c == "}":
            raise CssError("MALFORMED", "unmatched closing brace")
        elif depth == 0 and c in "{;":
            return m.start()
    return None


def _block_end(css: str, open_: int) -> int | None:
    depth = 0
    for m in _PIECE.finditer(css, open_):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0:
            return m.start()
    return None


def split_selectors(prelude: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for m in _PIECE.finditer(prelude):
        depth = max(0, depth + (m[0] in "([") - (m[0] in ")]"))
        if m[0] == "," and depth == 0:
            parts.append(prelude[start : m.start()])
            start = m.end()
    return [*parts, prelude[start:]]


def _below(selector: str, name: str, bounded: bool) -> str:
    """One selector below the class; a leading root element is the class itself."""
    if bounded:
        return f".{name}" if selector == "body" else f".{name} {selector}"
    rest, link = selector, None
    while m := _ROOT.match(rest):
        link, rest = (" > " if m[1] else " "), rest[m.end() :]
    if link is None or rest.startswith(("+", "~")):
        return f".{name} {selector}"
    return f".{name}{link}{rest}" if rest else f".{name}"


def _selectors(prelude: str, name: str, bounded: bool) -> str:
    if bounded and not _SIMPLE.fullmatch(prelude):
        raise CssError("UNSUPPORTED", f"selector {prelude!r}")
    parts = [p.strip() for p in split_selectors(prelude)]
    if "" in parts:
        raise CssError("MALFORMED", "empty selector")
    return ",".join(_below(p, name, bounded) for p in parts)


def _keyword(prelude: str) -> str | None:
    m = re.match(r"@([^\s({]*)", prelude)
    return m[1].lower() if m else None


def _rules(css: str, name: str, bounded: bool, depth: int) -> str:
    if depth > MAX_DEPTH:
        raise CssError("LIMIT", "nesting")
    out, at = [], 0
    while True:
        at += len(css[at:]) - len(css[at:].lstrip())
        if not bounded and (m := re.compile(r"<!--|-->").match(css, at)):
            at = m.end()
            continue
        if at >= len(css):
            return "".join(out)
        end = _prelude_end(css, at)
        if end is None:
            if bounded:
                raise CssError("UNSUPPORTED", "a statement without a block")
            return "".join(out)
        prelude = css[at:end].strip()
        word = _keyword(prelude)
        if css[end] == ";":
            if bounded or word not in ("charset", "namespace"):
                raise CssError("UNSUPPORTED", f"statement {prelude!r}")
            out.append(f"{prelude};" if word == "namespace" else "")
            at = end + 1
            continue
        close = _block_end(css, end)
        if close is None and bounded:
            raise CssError("MALFORMED", "unclosed block")
        body = css[end + 1 : close]
        at = len(css) if close is None else close + 1
        if prelude.startswith("@media ") if bounded else word in ("media", "supports"):
            if bounded and re.search("[<>;]", prelude):
                raise CssError("UNSUPPORTED", "media prelude")
            out.append(f"{prelude}{{{_rules(body, name, bounded, depth + 1)}}}")
        elif not bounded and word in DESCRIPTORS:
            out.append(f"{prelude}{{{body}}}")
        elif not bounded and word is not None:
            raise CssError("UNSUPPORTED", f"at-rule {prelude!r}")
        else:
            out.append(f"{_selectors(prelude, name, bounded)}{{{body}}}")


def scope(css: str, name: str, bounded: bool = True) -> str:
    """Every selector of the stylesheet below ``.name``."""
    return _rules(_without_comments(css, bounded), name, bounded, 0)


_UNSAFE = ("url(", "@import", "\\", "expression(", "behavior:", "-moz-binding")


def unsafe(css: str, compact: bool = True) -> str | None:
    """The first construct that a dictionary's styles may not have; compacting looks through white space."""
    text = re.sub(r"[ \t\n\f\r]+", "", css).lower() if compact else css.lower()
    return next((x for x in (_UNSAFE if compact else (*_UNSAFE, "<")) if x in text), None)


def isolate(css: str, ident: str) -> str:
    """Selectors prefixed with ``#gd-ident`` as a reader does it: split at every comma, text before an at-rule dropped."""
    out, at, css = [], 0, re.sub(r"/\*.*?(?:\*/|$)", "", css, flags=re.DOTALL)
    prefix = f"#gd-{ident}"
    while at < len(css):
        open_ = css.find("{", at)
        if open_ < 0:
            break
        prelude = css[at:open_]
        if "@" in prelude:
            start = at + prelude.index("@")
            semi = css.find(";", start)
            if 0 <= semi < open_:
                out.append(css[start : semi + 1])
                at = semi + 1
                continue
            close = _block_end(css, open_)
            body = css[open_ + 1 : close]
            nested = re.match(r"@(media|supports)", css[start:open_], re.IGNORECASE)
            out.append(css[start:open_] + "{" + (isolate(body, ident) if nested else body) + "}")
        else:
            close = _block_end(css, open_)
            parts = []
            for s in prelude.split(","):
                s = s.strip()
                root = re.match(r"(?:html|body)\b\s*", s, re.IGNORECASE)
                parts.append(f"{prefix} {s[root.end():]}".rstrip() if root else f"{prefix} {s}")
            out.append(", ".join(parts) + " {" + css[open_ + 1 : close] + "}")
        at = len(css) if close is None else close + 1
    return "\n".join(out)
