"""Lookups over a stream of queries: a static index joined to a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.words import ascii_lower


def exact_stream(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ordinal) for a streaming ``query`` column; stateless, so it runs in append mode."""
    return queries.join(index.select(F.col("key").alias("query"), "ordinal").distinct(), "query")


def ascii_case_stream(queries: DataFrame, index: DataFrame) -> DataFrame:
    keyed = index.select(ascii_lower(F.col("key")).alias("low"), "ordinal").distinct()
    return queries.withColumn("low", ascii_lower(F.col("query"))).join(keyed, "low").select("query", "ordinal")
