"""The reject channel: every failed check is a row, and strict mode raises if there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of failure and the exit status of each.
EXIT = {"MALFORMED": 3, "UNSUPPORTED": 4, "INCOMPLETE": 5, "LIMIT": 5, "IO": 6, "VERIFY": 7, "JSON": 7}


class CheckFailed(Exception):
    """Carries the first failure's code; ``exit_code`` follows from it."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.exit_code = code, EXIT.get(code, 1)


def failures(df: DataFrame, check: str, key: Column, bad: Column, code: str, message: str) -> DataFrame:
    """(check, key, code, message) of the rows where ``bad`` holds or is unknown."""
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(check).alias("check"), key.cast("string").alias("key"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def missing(left: DataFrame, right: DataFrame, on: list[str], check: str, key: str, code: str = "INCOMPLETE") -> DataFrame:
    """Rows of ``left`` without a partner, as failures: the twin of every inner join."""
    return failures(left.join(right, on, "left_anti"), check, F.col(key), F.lit(True), code, f"no {check}")


def together(*channels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, channels)


def require_none(channel: DataFrame) -> None:
    first = channel.orderBy("check", "key").limit(1).collect()
    if first:
        raise CheckFailed(first[0].code, f"{first[0].check} {first[0].key}: {first[0].message}")


def first_failure(rules: list[tuple[Column, str, str]]) -> Column:
    """(code, message) of the first rule, in order, whose condition holds; null if none does."""
    out = F.lit(None).cast("struct<code:string,message:string>")
    for bad, code, message in reversed(rules):
        out = F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))).otherwise(out)
    return out
