"""Vectorised text kernels shared by the operators of this package.

All of them work on the UTF-8 buffers of Arrow batches or on lists of byte
words, hold one bounded block of rows at a time, and give a null text the
value of an empty one.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

MASK64 = (1 << 64) - 1
#: Bytes of text that a kernel expands to numpy arrays at once.
BLOCK_BYTES = 1 << 20
#: Bytes of rows that a kernel sees at once, and that an Arrow batch is filled to (one row at least).
BATCH_BYTES = 2 << 20
SIEVE_WORDS = 1 << 18
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, whose worker gives its memory back after each partition.

    The batch bound is set for the session unless the session has one.
    """
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(cut(batches))
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def cut(batches, limit: int = BATCH_BYTES):
    """The batches in slices of about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.nbytes <= limit or len(batch) < 2:
            yield batch
            continue
        sizes = np.full(len(batch), 8, np.int64)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
                sizes += np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1])
            else:
                sizes += col.nbytes // len(col)
        for i, j in row_blocks(sizes, limit):
            yield batch.slice(i, j - i)


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__maybe``: false only where ``column`` is none of ``keys``.

    A bitmap of ``64 * SIEVE_WORDS`` bits of the keys' hashes is broadcast; its
    size does not follow the data, only how often a row passes for no reason.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * SIEVE_WORDS))
    bits = keys.select(place(key).alias("__at")).groupBy(F.expr("__at div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 AS int))")).alias("__bits"))
    met = rows.withColumn("__at", place(column)).join(F.broadcast(bits), F.expr("__at div 64") == F.col("__word"), "left")  # SIEVE_WORDS rows at most
    return met.withColumn("__maybe", F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__at % 64 AS int)) & 1") == 1, F.lit(False))).drop("__at", "__word", "__bits")


def release() -> None:
    """Drops the remembered hashes and returns free memory to the system; workers are used again by later stages."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)



def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; nulls become empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def row_blocks(sizes: np.ndarray, limit: int):
    """Consecutive row ranges (i, j) whose sizes add up to ``limit`` or that hold one row."""
    i, total = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(lists: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``width``-shingles of each list, flat, and where each list's begin.

    A list with fewer words gives one shingle of all its words, an empty one
    none. The second array has len(lists) + 1 entries.
    """
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((_HASHES[w] for ws in lists for w in ws), np.uint64, int(n.sum()))
    starts = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.repeat(starts[:-1] - out[:-1], count) + np.arange(out[-1])
    span = np.repeat(np.minimum(n, width), count)
    acc = np.repeat(np.minimum(n, width), count).astype(np.uint64)
    for k in range(width):
        inside = k < span
        h = flat[np.minimum(first + k, len(flat) - 1)]
        acc = np.where(inside, mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h), acc)
    return acc, out


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``k`` multiply-shift universal hash functions on 64-bit keys."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, k) uint32 minima of the permuted shingles; all ones for a row without shingles."""
    rows = len(starts) - 1
    out = np.full((rows, len(a)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(starts))
    for i, j in row_blocks(np.diff(starts)[full], 1 << 18):
        x = flat[starts[full[i]] : starts[full[j - 1] + 1]]
        at = starts[full[i:j]] - starts[full[i]]
        for k in range(len(a)):
            out[full[i:j], k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), at)
    return out
