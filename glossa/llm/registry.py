"""Registered queries of the ten operators and the SQL that they must equal, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, fingerprint, langid, mixing, mpeg, neardup, oracles, secrets, suffixtree, toxicity, warc
from glossa.runtime import crc_mod, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.spans_text(F.col("all")).alias("spans"), secrets.spans_text(F.col("specific")).alias("owner_specific"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    keyed = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return toxicity.score(keyed, field, keep=("doc_id", "held_out"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), width=3, threshold=85)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def codec(name: str = "byte_bpe_50k.tiktoken") -> bpe.Codec:
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), codec())


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_features(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(-1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (rest == 2).alias("held_out"))
    return langid.with_language(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_source_mix, op3_toxicity, op4_suffix_tree, op5_near_dedup, op6_fingerprint, op7_bpe, op8_mpeg_audio, op9_language_id, op10_warc)}

ORACLES: dict[str, str] = {"op5_near_dedup": oracles.OP5, "op10_warc": oracles.OP10}
