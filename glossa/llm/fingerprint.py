"""Document fingerprints by MinHash.

A text's fingerprint holds, for each of ``SIZE`` multiply-shift universal hash
functions, the least value over the text's word shingles (five words, A-Z in
lower case), as one hex string. The share of equal places estimates the
Jaccard similarity of two texts. ``matches`` joins signature bands in Spark
and verifies the Jaccard similarity on full shingle sets.

``with_successor`` gives each row its next one in descending key order without
a single-task window: keys are cut into runs at quantiles, the first row of
each run is also dealt to the run above, and each run is read as a stream.

Defined cases: a null text is an empty one; a text with fewer words than a
shingle has one shingle; without words the fingerprint is empty, like 1 to
another empty one and 0 to any other; repeated keys follow each other in the
order of their texts; null keys come last; a lone row is its own successor;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.runtime import partitions

SIZE, SEED, WIDTH = 64, 20240607, 5
#: Runs of keys for each shuffle partition.
RUNS = 3


def signatures(texts: list[str], width: int = WIDTH, size: int = SIZE) -> np.ndarray:
    a, b = tx.permutations(size, SEED)
    out = np.zeros((len(texts), size), np.uint32)
    for i, j in tx.row_blocks(np.fromiter(map(len, texts), np.int64, len(texts)), tx.BLOCK_BYTES):
        out[i:j] = tx.minhash(*tx.shingles([tx.words(t) for t in texts[i:j]], width), a, b)
    return out


def to_hex(sig: np.ndarray) -> list[str]:
    return ["" if (row == 0xFFFFFFFF).all() else row.astype(">u4").tobytes().hex() for row in sig]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def _dealt(docs: DataFrame) -> DataFrame:
    """(key, text, run, donor): the rows by run, and each run's first row again as the end of the run above."""
    spark = docs.sparkSession
    n = RUNS * partitions(spark)
    rows = docs.select("key", "text", F.col("key").cast("double").alias("at"))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)).first()[0] or [0.0]
    edges = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="at", outputCol="bucket", handleInvalid="keep")
    rows = cut.transform(rows.withColumn("at", F.coalesce("at", F.lit(0.0)))).select("key", "text", F.when(F.col("key").isNull(), -1).otherwise(F.col("bucket").cast("int")).alias("run"))
    tops = sorted(map(tuple, rows.groupBy("run").agg(F.max("key").alias("top")).collect()))  # a row for each run
    kind = docs.schema["key"].dataType.simpleString()
    donors = spark.createDataFrame([(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], f"top {kind}, above int")
    both = rows.join(F.broadcast(donors), F.col("key").eqNullSafe(F.col("top")), "left")
    own, other = F.struct("run", F.lit(False).alias("donor")), F.struct(F.col("above").alias("run"), F.lit(True).alias("donor"))
    return both.select("key", "text", F.inline(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, other))))


def _pairs(batches):
    """Lists (keys, texts) whose last row only serves as the successor of the row before."""
    held = None
    for batch in batches:
        keys, texts, donor = batch.column(0).to_pylist(), tx.texts(batch.column(1)), batch.column(3).to_pylist()
        if held:
            keys, texts, donor = [held[0], *keys], [held[1], *texts], [False, *donor]
        if len(keys) > 1:
            yield keys, texts, donor
        held = (keys[-1], texts[-1]) if keys and not donor[-1] else None if keys else held


def _compare(batches):
    for keys, texts, donor in _pairs(batches):
        at = [i for i in range(len(keys) - 1) if not donor[i]]
        edited = []
        for i in at:
            t = texts[i]
            k = len(t) // 3
            edited.append(t[: len(t) - k] + texts[i + 1][:k])
        own, other = signatures(texts), signatures(edited)
        near_edited, near_next = likeness(own[at], other), likeness(own[at], own[[i + 1 for i in at]])
        names = to_hex(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([keys[i] for i in at]).cast(pa.int64()) if not isinstance(keys[0], str) else pa.array([keys[i] for i in at]),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([names[i] for i in at], pa.string()),
                pa.array(to_hex(other), pa.string()),
                pa.array(near_edited, pa.float64()),
                pa.array(near_next, pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness to each other and to the next text's.

    The edited text has its last third replaced by the start of the next
    document in descending order of an integer ``key``.
    """
    rows = _dealt(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    runs = rows.repartition(partitions(docs.sparkSession), "run").sortWithinPartitions("run", "donor", F.col("key").desc_nulls_last(), "text")
    return tx.arrow_map(runs.select("key", "text", "run", "donor"), _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` of every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(signatures(tx.texts(batch.column(1)))), pa.string())], [key, "fingerprint"])

    return tx.arrow_map(docs.select(key, F.col(text).alias("text")), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def band_rows(threshold: float) -> int:
    """The most rows a band may have for a pair at the threshold to share no band with 3e-4 at most (else one)."""
    return max(r for r in range(1, SIZE + 1) if SIZE % r == 0 and (r == 1 or (1 - threshold**r) ** (SIZE // r) <= 3e-4))


def matches(queries: DataFrame, docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, jaccard) of a stated query set against all rows.

    Rows meet where a signature band is equal; each meeting pair is counted
    once and its similarity taken on the full shingle sets. The bands follow
    from the threshold (``band_rows``).
    """
    bands_of = SIZE // band_rows(threshold)

    def sets(batches):
        a, b = tx.permutations(SIZE, SEED)
        for batch in batches:
            flat, at = tx.shingles([tx.words(t) for t in tx.texts(batch.column(1))], width)
            sig = tx.minhash(flat, at, a, b)
            full = np.diff(at) > 0
            bands = [[hashlib.blake2b(bytes([i]) + part.tobytes(), digest_size=8).digest() for i, part in enumerate(np.split(row, bands_of))] if ok else [] for row, ok in zip(sig, full, strict=True)]
            held = [np.unique(flat[i:j]).view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.binary())), pa.array(held, pa.list_(pa.int64()))], [key, "bands", "members"])

    kind = docs.schema[key].dataType.simpleString()
    left, right = (tx.arrow_map(d.select(key, F.col(text).alias("text")), sets, f"`{key}` {kind}, bands array<binary>, members array<long>") for d in (queries, docs))
    ql, dl = (d.select(F.col(key).alias(n), F.explode("bands").alias("band")) for d, n in ((left, "query_id"), (right, "doc_id")))
    met = ql.join(dl, "band").where("query_id <> doc_id").select("query_id", "doc_id").distinct()
    full = met.join(left.select(F.col(key).alias("query_id"), F.col("members").alias("m1")), "query_id").join(right.select(F.col(key).alias("doc_id"), F.col("members").alias("m2")), "doc_id")
    shared = F.size(F.array_intersect("m1", "m2"))
    return full.select("query_id", "doc_id", (shared / (F.size("m1") + F.size("m2") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold)
