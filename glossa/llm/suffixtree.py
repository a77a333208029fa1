"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z in lower case) and one end for each text. The root has
the add-half unigram distribution over all training words. A context of up to
``DEPTH`` words is a state of the tree if it occurs ``least`` times in the
training text and its next-symbol distribution diverges from that of its
longest retained suffix, by ``DIVERGENCE`` nats a symbol and ``EVIDENCE`` nats
in all. A state gives discounted counts to the symbols that make up ``GAMMA``
of what follows it, and leaves the rest of its mass to its suffix state,
scaled to the symbols it does not name, so every state's distribution sums to
one. A text is scored from the longest suffix state before each symbol.

Counts cover all training text and are exact. Texts are packed once into chunks
of numbered words. Each chunk's distinct words go to a hash bucket, are summed
there, and the sums return to the chunks, so what is shuffled are distinct words
of chunks and not occurrences. Contexts are counted level by level: a context
of d words is no more frequent than its first d - 1 words followed by its last,
which the level before has counted, so only contexts that occur ``least`` times
are counted at all, and each of those completely. Neither states nor scores
depend on how texts are cut into chunks.

``least`` is a share ``SHARE`` of the training words of a small corpus and
grows with the root of a larger one, so the tree grows with the input: it has up
to 2 * DEPTH / GROWTH times the root of the words as states, until ``STATES``
contexts of each depth, which is what the driver and a worker are let hold.

Words and contexts are identified by 64-bit hashes. Defined cases: a null text
is an empty one and has the end only; a null id counts as training; repeated
rows are separate texts; a table without training rows gives every symbol the
unknown symbol's probability; a very long text is a chunk of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.runtime import partitions, stage, unstage

DEPTH, GAMMA = 3, 0.01
SHARE, GROWTH, STATES = 2e-4, 0.5, 1_000_000
DIVERGENCE, EVIDENCE, DISCOUNT = 0.01, 12.0, 0.5
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
END = tx.xxh64_intdigest(b"")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = "chunk long, docs array<long>, held binary, sizes binary, ids binary, names binary, counts binary"
SUMS = "kind string, chunk long, n long, one binary, two binary"


def least(total: int) -> int:
    """How often a context has to occur among ``total`` training symbols."""
    return max(2, math.ceil(max(min(SHARE * total, GROWTH * math.sqrt(total)), total / STATES)))


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(cols, types, strict=True)], list(names))


def _pack(batches):
    """A row for each chunk of the texts (doc_id, held_out, text): its documents' numbered words, and their names."""
    from pyspark import TaskContext

    chunk, size, vocab, docs = TaskContext.get().partitionId() << 32, 0, _Ids({b"": 0}), []

    def row():
        names = np.fromiter(map(tx.xxh64_intdigest, vocab), np.uint64, len(vocab))
        held = np.array([h for _, h, _ in docs], bool)
        learn = [d for _, h, d in docs if not h]
        counts = np.bincount(np.concatenate(learn) if learn else np.zeros(0, np.int64), minlength=len(vocab))
        sizes = np.array([len(d) for *_, d in docs], "<i4")
        return chunk, [i for i, *_ in docs], held.tobytes(), sizes.tobytes(), np.concatenate([d for *_, d in docs]).astype("<i4").tobytes(), names.tobytes(), counts.astype("<i4").tobytes()

    for batch in batches:
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tx.texts(batch.column(2)), strict=True):
            if docs and size + len(t) > CHUNK_BYTES:
                yield _batch(CHUNK, [row()])
                chunk, size, vocab, docs = chunk + 1, 0, _Ids({b"": 0}), []
            docs.append((i, h, np.fromiter(map(vocab.__getitem__, [*tx.words(t), b""]), np.int32)))
            size += len(t)
    if docs:
        yield _batch(CHUNK, [row()])


def _numbers(value, kind: str) -> np.ndarray:
    return np.frombuffer(bytes(value), kind)


def _deal(buckets: int):
    """The chunks' words (bucket, chunk, names, places, counts), those of a bucket together."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names, counts = _numbers(r["names"], np.uint64), _numbers(r["counts"], "<i4")
                at = (names % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(buckets + 1))
                rows = [(b, r["chunk"], names[o].tobytes(), o.astype("<i4").tobytes(), counts[o].tobytes()) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if lo < hi for o in [order[lo:hi]]]
                yield _batch("bucket long, chunk long, names binary, places binary, counts binary", rows)

    return run


def _sum_words(batches):
    """Reads the words in order of bucket; gives each bucket's totals (kind t) and what they are for each chunk (kind a)."""

    def bucket(rows):
        own = [_numbers(r["names"], np.uint64) for r in rows]
        names, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([_numbers(r["counts"], "<i4") for r in rows]), minlength=len(names)).astype("<i8")
        out, at = [("t", None, int((total > 0).sum()), names.tobytes(), total.tobytes())], 0
        for r, x in zip(rows, own, strict=True):
            out.append(("a", r["chunk"], None, r["places"], total[inverse[at : at + len(x)]].tobytes()))
            at += len(x)
        return _batch(SUMS, out)

    rows = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and rows[0]["bucket"] != r["bucket"]:
                yield bucket(rows)
                rows = []
            rows.append(r)
    if rows:
        yield bucket(rows)


def extend(context, name):
    """Hash of a context (0 for none) with one more word after it."""
    return tx.mix64(context * GOLDEN + name)


def _follow(depth: int, shared):
    """Of the chunks, counts (ctx, nxt, n) of what follows the contexts of ``depth`` words whose hashes are given, in order."""

    def run(batches):
        often = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                names, sizes, flat = _numbers(r["names"], np.uint64), _numbers(r["sizes"], "<i4"), _numbers(r["ids"], "<i4")
                inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.flatnonzero((inside >= depth) & ~np.repeat(_numbers(r["held"], bool), sizes))
                state = np.zeros(len(at), np.uint64)
                for back in range(depth, 0, -1):
                    state = extend(state, names[flat[at - back]])
                place = np.minimum(np.searchsorted(often, state), max(0, len(often) - 1))
                met = often[place] == state if len(often) else np.zeros(len(at), bool)
                code, n = np.unique(place[met] * len(names) + flat[at[met]], return_counts=True)
                ctx, nxt = np.divmod(code, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(often[ctx].view(np.int64)), pa.array(names[nxt].view(np.int64)), pa.array(n)], ["ctx", "nxt", "n"])

    return run


class Tree:
    """The retained states. Symbols are numbered in the order of ``names`` (hashes)."""

    def __init__(self, contexts: dict, counts: dict, total: int, distinct: int):
        """contexts: tuple of hashes -> (count, {hash: count}); counts: hash -> training count of the symbols."""
        self.names = np.array(sorted(counts), np.uint64)
        number = {h: i for i, h in enumerate(self.names.tolist())}
        self.scale = total + 0.5 * (distinct + 1)
        base = {h: (c + 0.5) / self.scale for h, c in counts.items()}
        kept: dict[tuple, dict] = {}
        rest: dict[tuple, float] = {}

        def suffix(ctx):
            ctx = ctx[1:]
            while ctx and ctx not in kept:
                ctx = ctx[1:]
            return ctx

        def prob(ctx, w):
            factor = 1.0
            while ctx:
                if w in kept[ctx]:
                    return factor * kept[ctx][w]
                factor *= rest[ctx]
                ctx = suffix(ctx)
            return factor * base[w]

        for ctx in sorted(contexts, key=lambda c: (len(c), c)):
            n, after = contexts[ctx]
            own = {w: (c - DISCOUNT) / n for w, c in after.items() if c >= GAMMA * n and w in base}
            if not own:
                continue
            parent = suffix(ctx)
            above = {w: prob(parent, w) for w in own}
            left, left_above = 1 - sum(own.values()), 1 - sum(above.values())
            if left_above <= 1e-9 or left <= 1e-9:
                continue
            gain = sum(p * np.log(p / above[w]) for w, p in own.items()) + left * np.log(left / left_above)
            if gain >= DIVERGENCE and gain * n >= EVIDENCE:
                kept[ctx], rest[ctx] = own, left / left_above
        nodes = {()} | {c[i:] for c in kept for i in range(len(c))}
        order = sorted(nodes, key=lambda c: (len(c), c))
        place = {c: i for i, c in enumerate(order)}
        self.symbols = max(1, len(self.names))
        steps = sorted((place[c[1:]] * self.symbols + number[c[0]], place[c]) for c in order if c)
        self.step_code, self.step_to = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))
        state = [place[c] if c in kept or not c else place[suffix(c)] for c in order]
        self.state = np.array(state, np.int64)
        self.parent = np.array([place[suffix(c)] if c else -1 for c in order], np.int64)
        self.rest = np.array([np.log10(rest[c]) if c in kept else 0.0 for c in order])
        named = sorted((place[c] * self.symbols + number[w], np.log10(p / base[w])) for c, own in kept.items() for w, p in own.items())
        self.code, self.gain = np.array([x[0] for x in named], np.int64), np.array([x[1] for x in named])
        self.states = len(kept)

    @staticmethod
    def _find(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
        return np.where(codes[at] == x, at, -1)

    def gains(self, sym: np.ndarray, new: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability in its state over that at the root; sym is -1 for other words."""
        node = np.zeros(len(sym), np.int64)
        live = np.flatnonzero(~new)
        back = 1
        while len(live) and back <= DEPTH:
            old = sym[live - back]
            live, old = live[old >= 0], old[old >= 0]
            at = self._find(self.step_code, node[live] * self.symbols + old)
            live = live[at >= 0]
            node[live] = self.step_to[at[at >= 0]]
            live = live[~new[live - back]]
            back += 1
        out, state = np.zeros(len(sym)), self.state[node]
        live = np.flatnonzero(state)
        while len(live):
            q = state[live]
            at = np.where(sym[live] >= 0, self._find(self.code, q * self.symbols + sym[live]), -1)
            out[live] += np.where(at >= 0, self.gain[np.maximum(at, 0)] if len(self.gain) else 0.0, self.rest[q])
            live, q = live[at < 0], q[at < 0]
            state[live] = self.parent[q]
            live = live[state[live] > 0]
        return out


def _score(model):
    """Reads rows in order of chunk, its words' sums before its texts."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def texts(r, sums):
        tree: Tree = model.value
        names, sizes, flat = _numbers(r["names"], np.uint64), _numbers(r["sizes"], "<i4"), _numbers(r["ids"], "<i4")
        logs, known = np.full(len(names), np.log10(0.5) - np.log10(tree.scale)), np.zeros(len(names), bool)
        for places, totals in sums:
            at, c = _numbers(places, "<i4"), _numbers(totals, "<i8")
            logs[at], known[at] = np.log10(c + 0.5) - np.log10(tree.scale), c > 0
        sym = Tree._find(tree.names, names)
        held, end = _numbers(r["held"], bool).tolist(), np.cumsum(sizes)
        for i, j in tx.row_blocks(sizes, 1 << 19):
            own = flat[end[i] - sizes[i] : end[j - 1]]
            starts = end[i:j] - sizes[i:j] - (end[i] - sizes[i])
            new = np.zeros(len(own), bool)
            new[starts] = True
            base = np.add.reduceat(logs[own], starts)
            more = np.add.reduceat(tree.gains(sym[own], new), starts)
            have = np.add.reduceat(known[own].astype(np.int64), starts)
            yield _batch(schema, list(zip(r["docs"][i:j], held[i:j], sizes[i:j].tolist(), have.tolist(), base.tolist(), (base + more).tolist(), strict=True)))

    def run(batches):
        chunk, sums = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    chunk, sums = r["chunk"], []
                if r["kind"] == "a":
                    sums.append((r["one"], r["two"]))
                else:
                    yield from texts(r, sums)

    return run, schema


def _hashes(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a small table as arrays, 64-bit hashes as unsigned numbers."""
    table = df.select(*columns).toArrow()
    return [c.to_numpy().view(np.uint64) if name != "n" and name != "m" else c.to_numpy() for name, c in zip(columns, table.columns, strict=True)]


def _words(summed: DataFrame, condition) -> dict[int, int]:
    """Training counts of the words that the condition on (names, totals) takes."""

    def run(batches):
        for batch in batches:
            for one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, totals = _numbers(one, np.uint64), _numbers(two, "<i8")
                ok = condition(names, totals)
                yield pa.RecordBatch.from_arrays([pa.array(names[ok].view(np.int64)), pa.array(totals[ok])], ["word", "n"])

    words, n = _hashes(tx.arrow_map(summed.where("kind = 't'").select("one", "two"), run, "word long, n long"), "word", "n")
    return dict(zip(words.tolist(), n.tolist(), strict=True))


def _total(chunks: DataFrame) -> int:
    """Number of training symbols."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_numbers(c, "<i4").sum(dtype=np.int64)) for c in batch.column(0).to_pylist()], pa.int64())], ["n"])

    return tx.arrow_map(chunks.select("counts"), run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _gather(chunks: DataFrame, summed: DataFrame, total: int) -> dict:
    """Contexts that occur ``least`` times, with their count and the symbols that make up GAMMA of what follows."""
    bound, spark = least(total), chunks.sparkSession
    words = _words(summed, lambda names, totals: (totals >= bound) & (names != np.uint64(END)))
    often = {int(extend(np.zeros(1, np.uint64), np.array([w], np.uint64))[0]): ((w,), n) for w, n in words.items()}
    contexts: dict = {}
    for depth in range(1, DEPTH + 1):
        if not often:
            break
        shared = spark.sparkContext.broadcast(np.array(sorted(often), np.uint64))
        flat = tx.arrow_map(chunks.select("held", "sizes", "ids", "names"), _follow(depth, shared), "ctx long, nxt long, n long")
        sums = stage(flat.groupBy("ctx", "nxt").agg(F.sum("n").alias("n")), "contexts")
        held = sums.groupBy("ctx").agg(F.sum("n").alias("m"))
        for c, w, n in zip(*(x.tolist() for x in _hashes(sums.join(held, "ctx").where(F.col("n") >= GAMMA * F.col("m")), "ctx", "nxt", "n")), strict=True):
            name, m = often[c]
            contexts.setdefault(name, (m, {}))[1][w] = n
        if depth < DEPTH:
            ctx, nxt, n = _hashes(sums.where((F.col("n") >= bound) & (F.col("nxt") != END - (1 << 64) * (END >> 63))), "ctx", "nxt", "n")
            often = {h: ((*often[c][0], w), k) for h, c, w, k in zip(extend(ctx, nxt).tolist(), ctx.tolist(), nxt.tolist(), n.tolist(), strict=True)}
        unstage(sums)
        shared.unpersist()
    return contexts


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    chunks = stage(tx.arrow_map(rows, _pack, CHUNK), "chunks")
    words = tx.arrow_map(chunks.select("chunk", "names", "counts"), _deal(4 * partitions(spark)), "bucket long, chunk long, names binary, places binary, counts binary")
    dealt = words.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "chunk")
    summed = stage(tx.arrow_map(dealt, _sum_words, SUMS), "sums")
    of = summed.where("kind = 't'")
    distinct = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = _total(chunks)
    contexts = _gather(chunks, summed, total)
    symbols = np.array(sorted({END} | {h for c, (_, after) in contexts.items() for h in (*c, *after)}), np.uint64)
    shared = spark.sparkContext.broadcast(symbols)
    counts = dict.fromkeys(symbols.tolist(), 0) | _words(summed, lambda names, totals: np.isin(names, shared.value))
    model = spark.sparkContext.broadcast(Tree(contexts, counts, total, distinct))
    sums = summed.where("kind = 'a'").select("kind", "chunk", "one", "two")
    both = chunks.drop("counts").withColumn("kind", F.lit("d")).unionByName(sums, allowMissingColumns=True)
    run, schema = _score(model)
    runs = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "kind")
    out = tx.arrow_map(runs, run, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
