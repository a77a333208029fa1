"""A training-data pipeline over ``documents``: language ID, near-dedup, secret scan, mixing, tokenization.

Each stage takes what its predecessor kept. All but the last return the
columns of documents.

Defined cases, for every stage: a null text is an empty one; an empty table
gives an empty one; a very long text is read whole; repeated rows are rows of
their own, but near-dedup keeps one row of an id; null ids, languages and
sources are kept as they are, and a row with a null id is a duplicate of
nothing; columns beyond those of documents pass unchanged up to the mixture and
may have any name that does not begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, langid, mixing, neardup, registry, secrets
from glossa.runtime import crc_mod, stage, table

#: The SQL of the whole run; None, as SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; the others' ``lang`` becomes the predicted one."""
    learn = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(-1)) != 2
    model = langid.fit(docs.where(learn))
    tagged = langid.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return tagged.where(F.col("__lang") != langid.UND).withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    return neardup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific, live-looking secrets in the text; keeps every document."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mixture takes, a row for each pass over it."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of each text and of what they decode to."""
    return bpe.digests(docs, registry.codec(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
