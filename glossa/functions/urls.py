"""URL and path functions: column expressions for whole tables, and scalar forms for kernels.

There are two grammars. The strict one reports a malformed reference (null
here, an error row in a reject channel); the lenient one keeps what it cannot
decode.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
EXTERNAL = ("http:", "https:", "mailto:")
WEB = ("data:", "http:", "https:", "ftp:")
MAX_PATH_BYTES, MAX_PATH_PARTS = 4096, 64


def percent_encode(text: Column, keep_slash: bool = False) -> Column:
    """All but unreserved characters as %XX of their UTF-8 bytes."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def percent_decode(text: Column) -> Column:
    """Strict: null for a malformed escape or bytes that are no UTF-8; a plus sign stays one."""
    return F.when(~text.rlike("%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))


def decode_strict(text: str) -> str:
    if _BAD_ESCAPE.search(text):
        raise ValueError("malformed escape")
    return unquote_to_bytes(text).decode()


def decode_lenient(text: str) -> str:
    return unquote_to_bytes(text).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def percent_decode_lenient(text: pd.Series) -> pd.Series:
    """Malformed escapes stay as they are; bytes that are no UTF-8 become U+FFFD."""
    return text.map(decode_lenient, na_action="ignore")


def _climb(start: Column, parts: Column) -> Column:
    """Folds path components onto a stack; null once ``..`` leaves the root."""

    def step(acc, part):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(acc.isNull(), acc).when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, start, step)


def clean_path(path: Column) -> Column:
    """Without empty and ``.`` components, ``..`` resolved and kept within the root."""
    empty = F.array().cast("array<string>")
    keep = F.aggregate(F.split(path, "/"), empty, lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(keep, "/")


def resolve(file: Column, url: Column) -> Column:
    """(kind, file, anchor) of a reference in ``file``: kind is internal, external or error."""
    low = F.lower(url)
    external = low.startswith(EXTERNAL[0]) | low.startswith(EXTERNAL[1]) | low.startswith(EXTERNAL[2])
    bad = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | url.contains("?") | url.contains("\\") | url.startswith("//") | url.startswith("/")
    path, anchor = percent_decode(F.split_part(url, F.lit("#"), F.lit(1))), percent_decode(F.regexp_extract(url, "^[^#]*#(.*)$", 1))
    folder = F.split(F.regexp_extract(file, "^(.*)/[^/]*$", 1), "/")
    start = F.filter(folder, lambda p: p != "")
    target = F.when(path == "", file).otherwise(F.array_join(_climb(start, F.split(path, "/")), "/"))
    kind = F.when(external, "external").when(bad | target.isNull() | (target == "") | anchor.isNull(), "error").otherwise("internal")
    inside = kind == "internal"
    return F.struct(kind.alias("kind"), F.when(inside, target).alias("file"), F.when(inside & (anchor != ""), anchor).alias("anchor"))


def relative(source: str, target: str) -> str:
    """The reference from one package file to another."""
    a, b = source.split("/")[:-1], target.split("/")
    n = 0
    while n < len(a) and n < len(b) - 1 and a[n] == b[n]:
        n += 1
    return "/".join([".."] * (len(a) - n) + [quote(p, safe="-._~") for p in b[n:]])


@F.pandas_udf(T.StringType())
def relative_path(source: pd.Series, target: pd.Series) -> pd.Series:
    return source.combine(target, lambda a, b: None if a is None or b is None else relative(a, b))


def resource_path(url: Column) -> Column:
    """Decoded path of a dictionary resource without leading slashes; null for data and web addresses."""
    low = F.lower(url)
    web = low.startswith(WEB[0]) | low.startswith(WEB[1]) | low.startswith(WEB[2]) | low.startswith(WEB[3])
    return F.when(~web, F.regexp_replace(percent_decode_lenient(url), "^/+", ""))


def package_path_ok(path: Column) -> Column:
    """A member path of a package: short, relative, portable, and free of tricks."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.endswith(".") | p.endswith(" "))
    return (F.octet_length(path) <= MAX_PATH_BYTES) & (F.size(parts) <= MAX_PATH_PARTS) & ~path.rlike(r"[\\:\p{Cc}]") & ~bad
