"""References that point to references: resolution by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.runtime import stage


def resolve_references(rows: DataFrame, key: str = "id", ref: str = "ref") -> DataFrame:
    """(key, root, depth): where each row's chain of references ends and after how many steps.

    A row without a reference is its own root, at depth 0. Each round doubles
    the distance, so n rows need log2(n) rounds of two joins; a row that is in
    a cycle, or leads to one, or to a missing row, has a null root and depth.
    """
    table = rows.select(F.col(key).alias("id"), F.col(ref).alias("to"))
    at = stage(table.select("id", F.coalesce("to", "id").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("to").isNull().alias("done")), "refs")
    n = at.count()
    rounds = max(1, n).bit_length()
    for _ in range(rounds):
        if not at.where("NOT done").limit(1).count():
            break
        ahead = at.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        joined = at.join(ahead, "at", "left")
        moved = joined.select(
            "id",
            F.when(F.col("done"), F.col("at")).otherwise(F.col("further")).alias("at"),
            F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"),
            (F.col("done") | F.coalesce("there", F.lit(False))).alias("done"),
        )
        at = stage(moved, "refs")
    return at.select(F.col("id").alias(key), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"))


def resolve_zero_lengths(spans: DataFrame, key: list[str], start: str = "start", length: str = "len") -> DataFrame:
    """Rows of length 0 take the one positive length that shares their start; ``len`` is null if there is none or several."""
    real = spans.where(F.col(length) > 0).groupBy(*key, start).agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    both = spans.join(real, [*key, start], "left")
    return both.withColumn(length, F.when(F.col(length) > 0, F.col(length)).when(F.col("lo") == F.col("hi"), F.col("lo"))).drop("lo", "hi")
