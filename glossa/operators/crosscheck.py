"""Two representations of one book reconciled: headwords, definitions and forms as multisets, in order and by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.multiset import difference
from glossa.operators.rejects import failures, together


def definitions(source: DataFrame, compiled: DataFrame) -> DataFrame:
    """Pairs the k-th source definition (book_id, pos, words) with the k-th distinct compiled span (book_id, start, end, words).

    A full outer join on rank: (book_id, k, words, start, end, same).
    """
    spans = compiled.groupBy("book_id", "start", "end").agg(F.array_sort(F.collect_list("word")).alias("have"))
    a = source.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))).select("book_id", "k", F.array_sort("words").alias("want"))
    b = spans.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("start", "end")))
    both = a.join(b, ["book_id", "k"], "full")
    return both.withColumn("same", F.col("want").eqNullSafe(F.col("have")))


def check(source_words: DataFrame, compiled_words: DataFrame, source_forms: DataFrame, compiled_forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reject channel of a cross-check: headwords (book_id, word) and forms (book_id, base, word) as multisets, and definitions."""
    words = difference(source_words, compiled_words, ["book_id", "word"])
    forms = difference(source_forms, compiled_forms, ["book_id", "base", "word"])
    return together(
        failures(words, "headword", F.col("word"), F.lit(True), "VERIFY", "counts differ"),
        failures(forms, "form", F.col("word"), F.lit(True), "VERIFY", "counts differ"),
        failures(pairs, "definition", F.col("k"), ~F.col("same"), "VERIFY", "headwords differ"),
    )


def reverse_rules(forward: DataFrame, back: DataFrame) -> DataFrame:
    """Edges (book_id, group, rule) that are not the same in both directions, for books that have reverse edges at all."""
    with_back = back.select("book_id").distinct()
    return difference(forward.join(with_back, "book_id", "left_semi"), back, ["book_id", "group", "rule"])
