"""Multiset comparisons, role claims, style sets and path collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.readers import collision_key
from glossa.operators.intervals import ordinals


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on..., n_left, n_right) of the items whose counts differ; nulls compare as values.

    One shuffle: both sides are tagged, united and counted together, combined
    before the shuffle.
    """
    both = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*on).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> n_right")


def totals(diff: DataFrame) -> DataFrame:
    """(n_missing, n_extra): rows of the left, and of the right, without a partner."""
    pos = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))
    return diff.agg(pos("n_left", "n_right").alias("n_missing"), pos("n_right", "n_left").alias("n_extra"))


def roles(claims: DataFrame, all_ids: DataFrame, key: str) -> DataFrame:
    """(key, role, n_claims): the only role claimed for each id, null where there is none or are several."""
    by = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role"))
    out = all_ids.select(key).join(by, key, "left")
    return out.select(key, F.when(F.col("n") == 1, F.col("role")).alias("role"), F.coalesce("n", F.lit(0)).alias("n_claims"))


def style_sets(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(key, set_id): rows with the same ordered list share a set, numbered by first appearance."""
    sets = lists.groupBy(items).agg(F.min(key).alias("first"))
    numbered = ordinals(sets, [F.col("first")], "set_id").drop("first")
    return lists.select(key, items).join(numbered, items).select(key, "set_id", items)


def path_collisions(paths: DataFrame, column: str = "path") -> DataFrame:
    """(key, n): directory prefixes and paths that differ in spelling only."""
    parts = F.split(column, "/")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    spelled = paths.select(prefixes.alias("p")).distinct().withColumn("key", collision_key("p"))
    return spelled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def file_directory_clashes(paths: DataFrame, column: str = "path") -> DataFrame:
    """Files that are also a directory of another file."""
    folder = F.regexp_extract(column, "^(.*)/[^/]*$", 1)
    parts = F.split(folder, "/")
    dirs = paths.where(F.col(column).contains("/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias(column)).distinct()
    return paths.join(dirs, column, "left_semi")
