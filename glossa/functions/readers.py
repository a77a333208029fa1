"""Functions that follow the rules of particular readers: folding, candidate spellings, group keys, clean-up."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(word: str) -> str:
    """Decomposed, without combining marks and anything but letters and digits, each character in lower case on its own."""
    return "".join(c.lower() for c in unicodedata.normalize("NFD", word) if c.isalnum() and not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def folded(word: pd.Series) -> pd.Series:
    return word.map(fold, na_action="ignore")


def spellings(word: str) -> list[str]:
    """What is tried in turn: as typed, lower, capitalised, upper, composed, decomposed, without marks."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.category(c).startswith("M"))
    tried = [word, word.lower(), word[:1].upper() + word[1:].lower(), word.upper(), unicodedata.normalize("NFC", word), unicodedata.normalize("NFD", word), plain]
    return [w for w in dict.fromkeys(tried) if w]


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidates(word: pd.Series) -> pd.Series:
    return word.map(spellings, na_action="ignore")


#: Ranges of code points by script.
HAN = ((0x2E80, 0x2EFF), (0x31C0, 0x31EF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
KANA = ((0x3041, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF))
CYRILLIC = ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0xA640, 0xA69F), (0xFE2E, 0xFE2F), (0x1D2B, 0x1D2B), (0x1D78, 0x1D78))
_KATAKANA = {n: n + 0x60 for n in (*range(0x3041, 0x3097), 0x309D, 0x309E)}


def _in(c: str, ranges) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in ranges)


def katakana(text: str) -> str:
    return text.translate(_KATAKANA)


def group_key(word: str) -> str:
    """The two-character group that a term is filed under."""
    head = word[:2].strip().lower()
    if not head or head[0] == "\0":
        return "11"
    head = head[:1] if head[1:2] == "\0" else head
    if _in(head[0], HAN):
        return head[0]
    if _in(head[0], KANA):
        return katakana(head)
    if _in(head[0], CYRILLIC):
        return head
    return head.ljust(2, "a") if head.isalpha() else "11"


@F.pandas_udf(T.StringType())
def kobo_group(word: pd.Series) -> pd.Series:
    return word.map(group_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def kobo_name(headword: pd.Series) -> pd.Series:
    """The name of a block: what follows the last separator, in katakana if it has kana."""

    def one(h: str) -> str:
        name = h.rsplit(", ", 1)[-1]
        return katakana(name) if any(_in(c, KANA) for c in name) else name

    return headword.map(one, na_action="ignore")


def kobo_definition(html: Column) -> Column:
    """Trimmed, without trailing breaks and document shell, images as their names."""
    text = F.regexp_replace(F.regexp_replace(html, r"^\s+|\s+$", ""), "(?:<br>|<BR>)+$", "")
    shell = r"(?s)^(?:<!DOCTYPE html>\s*<html|<html>).*?<body[^>]*>(.*?)</body.*$"
    text = F.when(text.rlike(shell), F.regexp_replace(text, shell, "$1")).otherwise(text)
    return F.regexp_replace(text, r'<img src="([^<>"]*)"(?: [^<>]*)?>', "[Image: $1]")


def popup_box(width: Column, height: Column, font: Column) -> Column:
    """(width, height, em) of a lookup window's text box on a screen, in device pixels."""
    scale = F.least(width, height) / F.lit(600.0)

    def px(n) -> Column:
        return F.ceil((n if isinstance(n, Column) else F.lit(float(n))) * scale)

    inner = width - px(80) - 2 * px(1.5) - 2 * px(10) - px(6) - px(12)
    em = px(font.cast("double"))
    line = F.greatest(F.floor(em * F.lit(1.3) + 0.5), F.lit(1))
    room = F.floor((height - 2 * px(5)) * F.lit(0.35))
    lines = F.greatest(F.floor(room / line + 0.5), F.lit(1))
    return F.struct(F.greatest(inner, F.lit(0)).cast("long").alias("width"), (lines * line).cast("long").alias("height"), em.cast("long").alias("em"))


def font_for(script: Column, serif: Column, bold: Column, italic: Column) -> Column:
    """The font file for a run of text, by its script and style."""
    style = F.when(bold & italic, "-BoldItalic").when(bold, "-Bold").when(italic, "-Italic").otherwise("-Regular")
    family = F.when(script == "cjk", "NotoSansCJKsc").when(script == "symbol", "Symbola").when(serif, "NotoSerif").otherwise("NotoSans")
    return F.concat(family, F.when(script.isin("cjk", "symbol"), "-Regular").otherwise(style), F.lit(".ttf"))


MAX_FOLDER_BYTES, MAX_CHAPTER_BYTES = 120, 250
#: Device names that no folder may have.
DEVICES = frozenset(["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))])


def folder(title: str) -> str:
    """A folder name that every system takes: no reserved character or name, 120 bytes at most."""
    words = re.sub(r'[/\\:*?"<>|\x00-\x1f\x7f-\x9f]', " ", title).split()
    kept, size = [], 0
    for w in words:
        n = len(w.encode()) + bool(kept)
        if size + n > MAX_FOLDER_BYTES:
            break
        kept.append(w)
        size += n
    name = " ".join(kept)
    if words and not kept:
        name = words[0].encode()[:MAX_FOLDER_BYTES].decode(errors="ignore")
    name = name.strip(". ")
    if not name:
        return "Dictionary"
    return f"_{name}" if name.split(".")[0].rstrip().upper() in DEVICES else name


@F.pandas_udf(T.StringType())
def folder_name(title: pd.Series) -> pd.Series:
    return title.map(folder, na_action="ignore")


def chapter(prefix: str, title: str) -> str:
    """The prefix and as many of the title's characters as keep the key under its byte bound."""
    left = MAX_CHAPTER_BYTES - 1 - len(prefix.encode())
    text = "".join(c for c in title if unicodedata.category(c) != "Cc").encode()
    return prefix + (text if len(text) <= left else text[: max(0, left)]).decode(errors="ignore")


@F.pandas_udf(T.StringType())
def chapter_key(prefix: pd.Series, title: pd.Series) -> pd.Series:
    return prefix.combine(title, lambda p, t: None if p is None or t is None else chapter(p, t))


@F.pandas_udf(T.StringType())
def collision_key(path: pd.Series) -> pd.Series:
    """Decomposed and in lower case: paths that some file systems take for one."""
    return path.map(lambda p: unicodedata.normalize("NFD", p).lower(), na_action="ignore")
