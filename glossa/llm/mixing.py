"""Mixing sources to target weights.

The words of each source are packed, document after document, into blocks of
``BLOCK`` words. Output shards of ``SHARD`` slots draw multinomial source
counts; draws beyond a source's quota go to the sources that are short, so
each source's words meet its target. A slot's running number within its source
is mapped through a pseudorandom permutation of the source's block indices (a
keyed Feistel network, new for every pass over the source), and slots join
blocks by index. A pass takes each block once; the last pass is cut at the
target word, so no word is taken more often than ``MAX_REPEATS`` times.

Nothing depends on partitioning: documents lie in hash buckets whose number
follows the row count, and a document's offset in its source is the sum over
earlier buckets (a small table) plus that within its bucket. The sources are
the components of a mixture: their table (name, size) is held by the driver
and refused beyond ``MAX_SOURCES``.

Defined cases: a null text has size 0 and takes 0; a null source is a source
of its own, the last; sources whose words are all taken ``MAX_REPEATS`` times
leave the excess to the others by weight; rows with the same id are separate
rows, and those alike in id, source and text take what any pairing gives them; an empty table, or one without words, takes nothing; other columns are
ignored and may have any name that does not begin with ``__``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import text as tx
from glossa.runtime import partitions, stage, unstage

BLOCK, SHARD, SEED = 256, 1024, 77
MAX_REPEATS, MAX_SOURCES = 3, 1_000_000
WEIGHTS = (1, 2, 3)
#: Rows in a hash bucket, and shards in a group, on average.
BUCKET_ROWS, GROUP_SHARDS = 4096, 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the summed sizes by weight, none above MAX_REPEATS times its size."""
    caps = [MAX_REPEATS * s for s in sizes]
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(caps[i])
            rest -= caps[i]
        free = [i for i in free if i not in set(over)]
    return out


class Plan:
    """For each source with words: passes, slots, and where its last slot ends."""

    def __init__(self, sizes: list[int], goal: list[float]):
        self.size = np.array(sizes, np.int64)
        words = np.minimum(np.rint(goal).astype(np.int64), MAX_REPEATS * self.size)
        self.blocks = -(-self.size // BLOCK)
        whole, rest = np.divmod(words, np.maximum(self.size, 1))
        self.slots, self.cut = whole * self.blocks, np.zeros(len(self.size), np.int64)
        for i in np.flatnonzero(rest):
            n, tail, r = int(self.blocks[i]), int(self.size[i] - (self.blocks[i] - 1) * BLOCK), int(rest[i])
            at = int(self._position(int(i), int(whole[i]), n - 1))
            if r <= at * BLOCK:
                used, cut = -(-r // BLOCK), r - (-(-r // BLOCK) - 1) * BLOCK
            elif r <= at * BLOCK + tail:
                used, cut = at + 1, r - at * BLOCK
            else:
                left = r - at * BLOCK - tail
                used = at + 1 + -(-left // BLOCK)
                cut = left - (-(-left // BLOCK) - 1) * BLOCK
            self.slots[i] += used
            self.cut[i] = cut
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // SHARD)

    def _network(self, source, epoch, n, x, inverse: bool) -> np.ndarray:
        """One walk of a four-round Feistel network over at least ``n`` values."""
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for step in reversed(range(4)) if inverse else range(4):
            key = (np.asarray(source, np.uint64) << np.uint64(20)) + (np.asarray(epoch, np.uint64) << np.uint64(4)) + np.uint64(step + (SEED << 44))
            if inverse:
                left, right = right ^ (tx.mix64(left * np.uint64(0x9E3779B97F4A7C15) + key) & mask), left
            else:
                left, right = right, left ^ (tx.mix64(right * np.uint64(0x9E3779B97F4A7C15) + key) & mask)
        return left << half | right

    def _walk(self, source, epoch, n, x, inverse: bool) -> np.ndarray:
        source, epoch, n = (np.atleast_1d(np.asarray(v)) for v in (source, epoch, n))
        x = self._network(source, epoch, n, np.atleast_1d(np.asarray(x, np.uint64)), inverse)
        while (out := np.flatnonzero(x >= n.astype(np.uint64))).size:
            x[out] = self._network(source[out], epoch[out], n[out], x[out], inverse)
        return x.astype(np.int64)

    def block_of(self, source: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block index and words taken from it, for the slots numbered ``j`` within their sources."""
        n = self.blocks[source]
        epoch, x = np.divmod(j, n)
        block = self._walk(source, epoch, n, x, False)
        length = np.minimum(BLOCK, self.size[source] - block * BLOCK)
        last = (j == self.slots[source] - 1) & (self.cut[source] > 0)
        return block, np.where(last, self.cut[source], length)

    def _position(self, source: int, epoch: int, block: int) -> int:
        return self._walk(source, epoch, self.blocks[source], block, True)[0]


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the group: over earlier buckets, then within the bucket."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(*group, bucket, F.coalesce(before, F.lit(0)).alias("__b"))
    within = F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__w", F.coalesce(within, F.lit(0))).join(base, [*group, bucket]).withColumn(name, F.col("__w") + F.col("__b")).drop("__w", "__b")


def _sized(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), F.xxhash64(text).alias("print"))


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, placed documents and taken pieces of the mixture of all rows of ``docs``.

    sources: (sid, source, source_size, target). placed: (doc_id, sid, size,
    print, start), one row per document, ``start`` being its first word in its
    source and ``print`` a hash of its text.
    taken: (doc_id, sid, size, start, shard, slot, lo, hi), the document's words
    [lo, hi) that a slot takes.
    """
    spark = docs.sparkSession
    sized = stage(_sized(docs, text, key, source), "sizes")
    table = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    found = table.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))])
    sources = spark.createDataFrame([(i, r.source, r.n, g) for i, (r, g) in enumerate(zip(found, goal, strict=True))], f"sid int, source {docs.schema[source].dataType.simpleString()}, source_size long, target double")
    buckets = max(1, -(-sum(r.rows for r in found) // BUCKET_ROWS))
    rows = sized.join(F.broadcast(sources.select("sid", F.col("source").alias("__src"))), F.col("source").eqNullSafe(F.col("__src"))).drop("__src", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    placed = stage(_running(rows, ["sid"], "bucket", ["doc_id", "size", "print"], "size", "start").drop("bucket"), "placed")
    unstage(sized)
    plan = Plan(sizes, goal)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    drawn = _slots(spark, plan)
    met = pieces.join(drawn.hint("merge"), ["sid", "block"])  # both sides grow with the corpus
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK) - F.col("start")
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("length")) - F.col("start")
    taken = met.select("doc_id", "sid", "size", "start", "shard", "slot", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return sources, placed, taken


def _slots(spark, plan: Plan) -> DataFrame:
    """(shard, slot, sid, block, length) of every slot of the output."""
    p = plan.slots / max(1, plan.total)

    def draw(batches):
        for batch in batches:
            shard, sid, n = [], [], []
            for s in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.Philox(key=SEED, counter=[0, 0, 0, s]))
                counts = rng.multinomial(min(SHARD, plan.total - s * SHARD), p)
                at = np.flatnonzero(counts)
                shard += [s] * len(at)
                sid += at.tolist()
                n += counts[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(sid, pa.int32()), pa.array(n, pa.int64())], ["shard", "sid", "n"])

    counts = stage(spark.range(plan.shards).mapInArrow(draw, "shard long, sid int, n long").withColumn("grp", F.expr(f"shard div {GROUP_SHARDS}")), "draws")
    numbered = _running(counts, ["sid"], "grp", ["shard"], "n", "first")
    got = {r.sid: r.n for r in counts.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    have = np.array([got.get(i, 0) for i in range(len(plan.slots))], np.int64)
    extra, short = np.maximum(have - plan.slots, 0), np.maximum(plan.slots - have, 0)
    extra_at, short_end = np.cumsum(extra) - extra, np.cumsum(short)

    def fill(batches):
        for batch in batches:
            sid, shard, n, first = (batch.column(c).to_numpy() for c in ("sid", "shard", "n", "first"))
            src, out = np.repeat(sid, n).astype(np.int64), np.repeat(shard, n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            over = j >= plan.slots[src]
            rank = extra_at[src[over]] + j[over] - plan.slots[src[over]]
            to = np.searchsorted(short_end, rank, side="right")
            src[over], j[over] = to, have[to] + rank - (short_end[to] - short[to])
            block, length = plan.block_of(src, j) if len(src) else (src, src)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(j, pa.int64()), pa.array(src, pa.int32()), pa.array(block, pa.int64()), pa.array(length, pa.int64())], ["shard", "slot", "sid", "block", "length"])

    return numbered.select("sid", "shard", "n", "first").mapInArrow(fill, "shard long, slot long, sid int, block long, length long")


def summary(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sources, placed, taken = mix(docs, text, key, source)
    rows = placed.where("size > 0").select("doc_id", "sid", "size", "start", F.lit(0).cast("long").alias("taken"))
    got = taken.select("doc_id", "sid", "size", "start", (F.col("hi") - F.col("lo")).alias("taken"))
    both = got.union(rows).groupBy("doc_id", "sid", "size", "start").agg(F.sum("taken").alias("taken"))
    both = both.union(placed.where("size = 0").select("doc_id", "sid", "size", "start", F.lit(0).cast("long")))
    return both.join(F.broadcast(sources.drop("source")), "sid").select("doc_id", "size", "source_size", "target", "taken")


def sample(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: for each document and pass, the words that the mixture takes.

    A document that is taken k times in a pass's blocks gives k rows at most,
    each holding the taken stretches of its text in order, one to a line; a
    document of which nothing is taken gives none, one without words stays.
    """
    sources, placed, taken = mix(docs, text, key, source)
    order = F.row_number().over(Window.partitionBy("sid", "start", "lo").orderBy("slot"))
    turns = taken.select("sid", "start", "lo", "hi", "slot").withColumn("turn", order).groupBy("sid", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
    per_doc = turns.groupBy("sid", "start").agg(F.collect_list("cuts").alias("turns"))
    # rows alike in id, source and text are numbered on either side, whether taken or not; any pairing of them is right
    alike = ["doc_id", "sid", "print"]
    nth = placed.where("size > 0").withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("start")))
    cuts = nth.join(per_doc, ["sid", "start"]).groupBy(F.xxhash64(*alike).alias("__own")).agg(F.collect_list(F.struct(*alike, "nth", "turns")).alias("__cuts"))
    return _rows(docs, sources, cuts, text, key, source)


def _rows(docs: DataFrame, sources: DataFrame, cuts: DataFrame, text: str, key: str, source: str) -> DataFrame:
    import pandas as pd

    def cut(batches):
        find = re.compile(WORD).finditer
        for parts in batches:
            out = []
            for s, lists in zip(*parts, strict=True):
                at = [m.span() for m in find(s or "")]
                out.append(["\n".join(s[at[a][0] : at[b - 1][1]] for a, b in _joined(cuts)) for cuts in lists])
            yield pd.Series(out, dtype=object)
        tx.release()

    cut = F.pandas_udf(cut, T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR_ITER)
    names = sources.select(F.col("source").alias("__source"), F.col("sid").alias("__own_sid"))
    rows = docs.withColumns({"__size": _size(text), "__own_print": F.xxhash64(text)})
    empty = rows.where("__size = 0").select(*docs.columns)
    full = rows.where("__size > 0").join(F.broadcast(names), F.col(source).eqNullSafe(F.col("__source")))
    # texts are shuffled once: one hash of what tells documents apart deals them out for their numbers and for their cuts
    alike = [F.col(key), F.col("__own_sid"), F.col("__own_print")]
    full = full.withColumn("__own", F.xxhash64(*alike)).repartition(partitions(docs.sparkSession), "__own")
    full = full.withColumn("__own_nth", F.row_number().over(Window.partitionBy("__own", *alike).orderBy(F.lit(0))))
    own = F.filter("__cuts", lambda c: F.col(key).eqNullSafe(c.doc_id) & (c.sid == F.col("__own_sid")) & (c.print == F.col("__own_print")) & (c.nth == F.col("__own_nth")))
    met = full.join(cuts.hint("merge"), "__own").withColumn("__turns", F.get(own, F.lit(0)).turns).where("__turns IS NOT NULL")
    taken = met.withColumn("__piece", F.explode(cut(F.col(text), F.transform("__turns", lambda x: F.transform(x, lambda c: F.array(c.lo, c.hi))))))
    piece = {text: F.col("__piece")} | ({"n_chars": F.length("__piece").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return taken.select(*(piece.get(c, F.col(c)).alias(c) for c in docs.columns)).unionByName(empty)


def _joined(cuts) -> list[tuple[int, int]]:
    """Adjacent stretches as one."""
    out: list[tuple[int, int]] = []
    for c in cuts:
        a, b = int(c[0]), int(c[1])
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
