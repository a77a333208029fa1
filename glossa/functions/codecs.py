"""Column forms of the byte formats of compiled books: numbers, compressed text, edit programs, old encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import book_kernel as bk

#: Bytes that a compressed record may expand to.
MAX_RECORD = 1 << 26


def _each(f):
    """``f`` of bytes; null for bytes that the format refuses."""

    def one(data):
        try:
            return f(bytes(data))
        except bk.BookError:
            return None

    return one


@F.pandas_udf(T.LongType())
def vint(data: pd.Series) -> pd.Series:
    """The base-128 number that the bytes begin with."""
    return data.map(_each(lambda d: bk.vint(d, 0)[0]), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def packed(data: pd.Series) -> pd.Series:
    return data.map(_each(bk.pack_palmdoc), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def unpacked(data: pd.Series) -> pd.Series:
    return data.map(_each(lambda d: bk.palmdoc(d, MAX_RECORD)), na_action="ignore")


@F.pandas_udf(T.StringType())
def windows_1252(data: pd.Series) -> pd.Series:
    return data.map(_each(lambda d: bk.decode(d, 1252)), na_action="ignore")


@F.pandas_udf(T.StringType())
def inflected(base: pd.Series, program: pd.Series) -> pd.Series:
    """A word changed by an edit program; null where the program does not fit the word."""
    return base.combine(program, lambda b, p: None if b is None or p is None else _each(lambda d: bk.edit_word(b.encode(), d).decode())(p))


@F.pandas_udf(T.BinaryType())
def without_trailers(record: pd.Series, flags: pd.Series) -> pd.Series:
    return record.combine(flags, lambda r, f: None if r is None or f is None else _each(lambda d: bk.strip_trailers(d, int(f)))(r))
