"""MinHash near-dedup by chosen-path set similarity join.

A document's set holds its distinct word shingles; equal sets are merged
first. Each of ``TREES`` independent trees branches documents recursively: a
node selects, by a hash of its path, 1/branching of the ``COORDINATES``
minwise tokens on average (one at least), and a document goes to the child
named by its own minimum there. Nodes of at most ``NODE`` documents are
compared exhaustively and branch no further: all pairs on their minwise
tokens first, and what may be linked (``SLACK`` standard deviations below the
threshold count) on full sets. Larger nodes branch again, up to ``DEPTH``
levels. Dense groups of near copies, which branching
hardly separates, are met in two more ways: the documents of larger nodes of
the first and last level are also cut into hash blocks of about ``NODE``, each
compared like a small node, and the centres of a node, the ``CENTRES``
documents with the largest share of likely links within their blocks, are
compared with all of its documents that are not in their component yet.

Nodes that are still large at the last level are compared whole, too: their
documents' minwise tokens in blocks of ``BLOCK``, every block with every other,
but for documents of the component that most of them are in by now. Those that
may be linked with one of another component are joined exactly: a linked pair
shares a shingle among the rarest of either (the prefix filter), so those who
share one and are in different components are compared, in blocks again where
more than ``NODE`` share one. This is quadratic only in documents of dense nodes
that are not linked; a group of copies meets as one component.

A pair at the threshold may be parted at each level. Twelve trees miss one
that has to meet at the last level with 6e-7 at 0.85 and 4e-6 at 0.8
(``recall_at``), and fewer at the levels before.
A node returns the links that
connect it (a star for each linked part), so a group of m documents costs m
rows, never m squared. Sizes of nodes are counted before their members are
gathered, so no task gathers more than about ``NODE`` documents of a group.

Defined cases: documents without words or with null text have no set and link
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; equal sets link whatever their size; rows that repeat an id are one
document (should their texts differ, one of them stands for the id when
compared); rows with a null id are linked with nothing; a very long text is
one set; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.operators.graph import connected_components
from glossa.runtime import partitions, stage, unstage

WIDTH, THRESHOLD = 5, 80
COORDINATES, TREES, DEPTH, NODE, SEED = 64, 12, 3, 128, 5
#: A linked pair with fewer equal coordinates than the cut has a chance below 1e-7.
SLACK = 5.5
CENTRES = 3
#: Documents of a block of a node that stays large, and pairs of them that are compared at once.
BLOCK, TILE = 2048, (256, 1024)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _sets(width: int):
    def run(batches):
        a, b = tx.permutations(COORDINATES, SEED)
        for batch in batches:
            texts = tx.texts(batch.column(1))
            n, keys, sigs, sketches = [], [], [], []
            for i, j in tx.row_blocks(np.fromiter(map(len, texts), np.int64, len(texts)), tx.BLOCK_BYTES):
                flat, at = tx.shingles([tx.words(t) for t in texts[i:j]], width)
                sig = tx.minhash(flat, at, a, b)
                for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    s = np.unique(flat[lo:hi])
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(sig[r].astype("<u2").tobytes() if len(s) else None)
                    sketches.append(sig[r].astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, sigs, sketches))], ["doc_id", "n_shingles", "key", "sig", "sketch"])

    return run


def _children(path: np.ndarray, branching: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of the children that each node selects."""
    h = tx.mix64(path * GOLDEN + np.uint64(1))
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    rows, coords = [np.arange(len(path))], [first]
    whole = max(1, int(branching))
    for k in range(1, whole + 1):
        h = tx.mix64(h + np.uint64(k) * GOLDEN)
        go = np.ones(len(path), bool) if k < whole else (h >> np.uint64(11)).astype(np.float64) / 2**53 < branching - whole
        step = 1 + (h % np.uint64(COORDINATES - 1)).astype(np.int64)
        rows.append(np.flatnonzero(go))
        coords.append(((first + step) % COORDINATES)[go])
    return np.concatenate(rows), np.concatenate(coords)


def _branch(branching: float, level: int):
    """Children of each row (rep, sig, paths); at level 0 a row is (rep, sig), at the root of every tree."""

    def run(batches):
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(rep), COORDINATES)
            if level == 0:
                at = np.repeat(np.arange(len(rep)), TREES)
                path = tx.mix64(np.tile(np.arange(1, TREES + 1, dtype=np.uint64), len(rep)) * GOLDEN)
            else:
                at = np.repeat(np.arange(len(rep)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                path = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, coords = _children(path, branching)
            child = tx.mix64(tx.mix64(path[rows] + np.uint64(level + 1)) ^ (sig[at[rows], coords].astype(np.uint64) << np.uint64(8) | coords.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[at[rows]]), pa.array(child.view(np.int64))], ["rep", "path"])

    return run


def _linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Part (smallest index) of each of a node's sets, all pairs compared exactly."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.bincount(inverse, minlength=len(values))
    common = np.zeros((m, m), np.int64) + (shared == m).sum()
    column = np.cumsum((shared > 1) & (shared < m)) - 1
    used = ((shared > 1) & (shared < m))[inverse]
    owner, inverse = owner[used], column[inverse[used]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total = int(inverse[-1]) + 1 if len(inverse) else 0
    for lo in range(0, total, 8192):
        i, j = np.searchsorted(inverse, [lo, lo + 8192])
        part = np.zeros((m, min(8192, total - lo)), np.float32)
        part[owner[i:j], inverse[i:j] - lo] = 1
        common += np.rint(part @ part.T).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    link = 100 * common >= threshold * union
    np.fill_diagonal(link, False)
    part = np.full(m, -1)
    for s in range(m):
        if part[s] < 0:
            part[s], front = s, [s]
            while front:
                new = np.flatnonzero(link[front].any(axis=0) & (part < 0))
                part[new], front = s, new.tolist()
    return part


def _cut(threshold: int) -> int:
    """Equal coordinates that a linked pair has at least."""
    t = threshold / 100
    return math.floor(COORDINATES * t - SLACK * math.sqrt(COORDINATES * t * (1 - t)))


def _whole_nodes(batches):
    """The batches' columns as lists of Arrow arrays, cut where the first column changes; rows come in its order."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(node == node[-1])[0])  # where the last node begins
        if held and held[-1].column(0)[0].as_py() == node[-1]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, k: int) -> pa.Array:
    col = table.column(k)
    return col.chunk(0) if col.num_chunks else pa.array([], col.type)


def _pairs(node: np.ndarray, most: int = 1 << 16):
    """All pairs (i, j) of rows of one node, rows being in order of node, in blocks."""
    for d in range(1, len(node)):
        at = np.flatnonzero(node[:-d] == node[d:])
        if not len(at):
            return
        for lo in range(0, len(at), most):
            yield at[lo : lo + most], at[lo : lo + most] + d


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows is connected with by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _likely(threshold: int):
    """Reads rows (node, rep, sketch) in order of node and rep.

    Gives the sorted ids of each part of a node whose pairs may be linked, and
    each node's document with the most such pairs, with its share of them.
    """
    least = _cut(threshold)

    def run(batches):
        for table in _whole_nodes(batches):
            node, rep = (_column(table, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            if not len(node):
                continue
            first = np.concatenate([[True], (node[1:] != node[:-1]) | (rep[1:] != rep[:-1])])
            node, rep, x = node[first], rep[first], _matrix(_column(table, 2))[first]
            near = [(i[ok], j[ok]) for i, j in _pairs(node) if (ok := (x[i] == x[j]).sum(axis=1) >= least).any()]
            if not near:
                continue
            a, b = (np.concatenate([e[k] for e in near]) for k in (0, 1))
            part = _parts(len(node), a, b)
            held = np.flatnonzero(np.bincount(part, minlength=len(node))[part] > 1)
            held = held[np.argsort(part[held], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], part[held][1:] != part[held][:-1], [True]]))
            degree = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            size = np.diff(start)
            best = np.lexsort((np.arange(len(node)), -degree, np.repeat(np.arange(len(size)), size)))[start[:-1]]
            best, size = best[degree[best] > 0], size[degree[best] > 0]
            reps = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(rep[held]))
            yield _row_batch(node[held[edge[:-1]]], reps, None, None)
            yield _row_batch(node[best], None, rep[best], degree[best] / np.maximum(size - 1, 1))

    return run


def _apart(threshold: int):
    """Reads rows (node, rep, comp, sketch) in order of node; gives the ids that may be linked with one of another component."""
    least = _cut(threshold)

    def hits(comp, x):
        found = np.zeros(len(comp), bool)
        for i in range(0, len(comp), TILE[0]):
            a = slice(i, i + TILE[0])
            for j in range(i - i % TILE[1], len(comp), TILE[1]):
                b = slice(j, j + TILE[1])
                other = comp[a, None] != comp[None, b]
                if not other.any():
                    continue
                equal = np.zeros(other.shape, np.uint8)
                for c in range(COORDINATES):
                    equal += x[a, c, None] == x[None, b, c]
                other &= equal >= least
                found[a] |= other.any(axis=1)
                found[b] |= other.any(axis=0)
        return found

    def run(batches):
        for table in _whole_nodes(batches):
            node, rep, comp = (_column(table, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2))
            if not len(node):
                continue
            x, edge = _matrix(_column(table, 3)), np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                order = lo + np.argsort(comp[lo:hi], kind="stable")
                own = rep[order][hits(comp[order], x[order])]
                yield pa.RecordBatch.from_arrays([pa.array(own)], ["rep"])

    return run


def _row_batch(node, reps, centre, degree) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64())
    cols = [pa.nulls(len(node), k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip((node, reps, centre, degree), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["node", "reps", "centre", "degree"])


def _matrix(col: pa.Array) -> np.ndarray:
    """The sketches of a binary column, a row each."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(col), COORDINATES)


def _near_pairs(threshold: int):
    """Of rows (rep, centre, sketch, of_centre), the pairs that may be linked."""
    least = _cut(threshold)

    def run(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(c)) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _compare(width: int, threshold: int):
    """Reads rows (node, rep, text) in order of node and rep; gives the links that connect each node's parts."""

    def block(node, rep, texts):
        flat, off = tx.shingles([tx.words(t) for t in texts], width)
        owner = np.repeat(np.arange(len(texts)), np.diff(off))
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        first = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])[: len(flat)]
        flat, owner = flat[first], owner[first]
        size = np.bincount(owner, minlength=len(texts))
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        members, end = np.diff(start), np.cumsum(size)
        two = start[:-1][members == 2]
        # of the nodes of two documents all at once: shingles that stand twice in a node
        place = np.repeat(np.arange(len(members)), members)
        inside = np.repeat(members == 2, members)[owner]
        at, values = place[owner[inside]], flat[inside]
        order = np.lexsort((values, at))
        at, values = at[order], values[order]
        twice = (at[1:] == at[:-1]) & (values[1:] == values[:-1])
        common = np.bincount(at[1:][twice], minlength=len(members))[members == 2]
        linked = two[100 * common >= threshold * (size[two] + size[two + 1] - common)]
        yield _edges(rep[linked], rep[linked + 1])
        for k in np.flatnonzero(members > 2):
            part = _linked([flat[end[i] - size[i] : end[i]] for i in range(start[k], start[k + 1])], threshold)
            own = rep[start[k] : start[k + 1]]
            yield _edges(own[part], own)

    def run(batches):
        for table in _whole_nodes(batches):
            node, rep = (_column(table, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (rep[1:] != rep[:-1])])[: len(node)])
            node, rep, texts = node[first], rep[first], tx.texts(_column(table, 2).take(pa.array(first)))
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[: len(node)])
            size = np.add.reduceat(np.fromiter(map(len, texts), np.int64, len(texts)), start) if len(texts) else start
            stop = np.append(start, len(node))
            for i, j in tx.row_blocks(size, tx.BLOCK_BYTES):
                yield from block(node[stop[i] : stop[j]], rep[stop[i] : stop[j]], texts[stop[i] : stop[j]])

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The links (a, b) but for those of a document with itself."""
    return pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], ["a", "b"])


def _texts_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` with the text of their ``rep``; the texts of few other documents are shuffled (``tx.sifted``)."""
    texts = tx.sifted(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", members, "rep").where("__maybe").drop("__maybe")
    return members.hint("merge").join(texts, "rep")


def _compared(members: DataFrame, docs: DataFrame, width: int, threshold: int, label: str) -> DataFrame:
    """Links (a, b) within the nodes given as rows (node, rep)."""
    rows = _texts_of(members, docs).select("node", "rep", "text")
    runs = rows.repartition(partitions(docs.sparkSession), "node").sortWithinPartitions("node", "rep", "text")
    return stage(tx.arrow_map(runs, _compare(width, threshold), "a long, b long"), label)


def _tokens(width: int):
    """Of rows (rep, text), the distinct shingles of each as rows (rep, token)."""

    def run(batches):
        for batch in batches:
            reps, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), tx.texts(batch.column(1))
            for i, j in tx.row_blocks(np.fromiter(map(len, texts), np.int64, len(texts)), tx.BLOCK_BYTES):
                flat, at = tx.shingles([tx.words(t) for t in texts[i:j]], width)
                token = [np.unique(flat[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
                rep = np.repeat(reps[i:j], [len(t) for t in token])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(token).view(np.int64))], ["rep", "token"])

    return run


def _sharing(rest: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of rows (rep, comp), nodes (reps) in which every linked pair of different ``comp`` meets, by the prefix filter."""
    texts = _texts_of(rest.select("rep"), docs).groupBy("rep").agg(F.min("text").alias("text"))
    tokens = stage(tx.arrow_map(texts, _tokens(width), "rep long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    of = Window.partitionBy("rep")
    ranked = tokens.hint("merge").join(often, "token").withColumn("k", F.row_number().over(of.orderBy("df", "token"))).withColumn("n", F.count(F.lit(1)).over(of))
    prefix = ranked.where((F.col("df") > 1) & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)).select("rep", "token")
    prefix = stage(prefix.hint("merge").join(rest, "rep").select("rep", "token", "comp"), "prefixes")
    unstage(tokens)
    met = prefix.hint("merge").join(_mixed(prefix, "token"), "token")
    at = _cells(F.col("s"), F.col("m"), F.col("comp") == F.col("most"), "rep", NODE // 2)
    placed = met.select("token", "rep", F.explode(at).alias("cell"))
    return placed.groupBy("token", "cell").agg(F.sort_array(F.collect_set("rep")).alias("reps")).where("size(reps) > 1").select("reps").distinct()


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with more edges (a, b): only the components that these connect are joined, as a smaller graph."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct()
    joined = connected_components(named).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    rows = labels.select("node", "component").unionByName(ends.select("node", F.col("node").alias("component")))
    return stage(rows.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels")


def _cells(stats_s, stats_m, inner, key, size: int):
    """Cells in which a row meets all others of its group (s rows, m of the largest component) but those of that component, if it is of it.

    The largest component's rows and the others are cut into blocks of
    ``size``; every block of others meets every block.
    """
    ours, others = F.ceil(stats_m / size), F.ceil((stats_s - stats_m) / size)
    block = F.pmod(F.xxhash64(key), F.when(inner, ours).otherwise(others))

    def cells(kind, count, of):
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda j: F.xxhash64(F.lit(kind), *of(j)))

    across = F.when(inner, cells("m", others, lambda j: (j, block))).otherwise(F.concat(cells("m", ours, lambda j: (block, j)), cells("u", others, lambda j: (F.least(block, j), F.greatest(block, j)))))
    return F.when(stats_s <= 2 * size, F.array(F.lit(0).cast("long"))).otherwise(across)


def _mixed(rows: DataFrame, group: str) -> DataFrame:
    """Of rows (group, rep, comp), the groups of several components: their size s, and the largest component and its size m."""
    by = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy(group).agg(F.sum("k").alias("s"), F.max("k").alias("m"), F.max_by("comp", "k").alias("most")).where("s > m")


def _open(large: DataFrame, labels: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """(rep, comp) of the documents of large nodes (path, rep) whose sketch says that they may be linked with one of another component."""
    spark = large.sparkSession
    members = stage(large.join(labels, "rep", "left").select("path", "rep", F.coalesce("component", "rep").alias("comp")), "residual")
    met = members.hint("merge").join(_mixed(members, "path"), "path")
    at = _cells(F.col("s"), F.col("m"), F.col("comp") == F.col("most"), "rep", BLOCK)
    rows = met.select("rep", "comp", F.explode(F.transform(at, lambda c: F.xxhash64("path", c))).alias("node")).hint("merge").join(sketches, "rep").select("node", "rep", "comp", "sketch")
    rows = rows.repartition(partitions(spark), "node").sortWithinPartitions("node", "rep")
    found = stage(tx.arrow_map(rows, _apart(threshold), "rep long"), "open")
    rest = stage(found.distinct().join(members.select("rep", "comp").distinct(), "rep"), "rest")
    unstage(members, found)
    return rest


def link(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents link where 100 * intersection >= ``threshold`` * union of their
    sets; a component's id is its smallest ``key``, an integer.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = stage(tx.arrow_map(docs, _sets(width), "doc_id long, n_shingles long, key binary, sig binary, sketch binary"), "sets")
    first = base.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"))
    rows = base.join(first, "key", "left").select("doc_id", "n_shingles", "rep", *(F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("sig", "sketch")))
    rows = stage(rows, "members")
    unstage(base)
    reps = rows.where("sig IS NOT NULL").select("rep", "sig")
    sketches = rows.where("sig IS NOT NULL").select("rep", "sketch")
    branching = 100 / threshold

    held, level, nodes, larger, tree = [], 0, None, None, tx.arrow_map(reps, _branch(branching, 0), "rep long, path long")
    while True:
        drawn = stage(tree, "paths")
        sizes = drawn.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        tree = stage(drawn.join(sizes, "path"), "paths")
        unstage(drawn)
        held.append(tree)
        small = tree.where(F.col("n") <= NODE).groupBy("path").agg(F.sort_array(F.collect_set("rep")).alias("reps")).where("size(reps) > 1").select("reps").distinct()
        large = tree.where(F.col("n") > NODE)
        level += 1
        nodes = small if nodes is None else nodes.union(small)
        if level in (1, DEPTH):
            larger = large if larger is None else larger.union(large)
        residual = bool(large.limit(1).count())
        if level == DEPTH or not residual:
            break
        packed = large.groupBy("rep").agg(F.collect_set("path").alias("paths"))
        tree = tx.arrow_map(packed.join(reps, "rep").select("rep", "sig", "paths"), _branch(branching, level), "rep long, path long")

    listed = nodes.distinct().select(F.xxhash64("reps").alias("node"), F.explode("reps").alias("rep"))
    blocks = larger.select("path", "rep", F.xxhash64("path", F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("n") / NODE))).alias("node"))
    runs = listed.union(blocks.select("node", "rep")).hint("merge").join(sketches, "rep").select("node", "rep", "sketch").repartition(partitions(spark), "node").sortWithinPartitions("node", "rep")
    likely = stage(tx.arrow_map(runs, _likely(threshold), "node long, reps array<long>, centre long, degree double"), "likely")
    parts = likely.where("reps IS NOT NULL").select("reps").distinct().select(F.xxhash64("reps").alias("node"), F.explode("reps").alias("rep"))
    found = _compared(parts, docs, width, threshold, "links")

    labels = connected_components(found)
    best = likely.where("centre IS NOT NULL").join(blocks.select("path", "node").distinct(), "node")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("degree"), "centre"))
    whose = labels.select(F.col("node").alias("centre"), F.col("component").alias("c2"))
    top = best.select("path", "centre", "degree").distinct().withColumn("k", rank).where(F.col("k") <= CENTRES)
    of_path = top.join(whose, "centre", "left").groupBy("path").agg(F.collect_list(F.struct("centre", F.coalesce("c2", "centre").alias("comp"))).alias("centres"))
    # a row for each document, however many centres its nodes have; those of its own component need no comparison
    own = labels.select(F.col("node").alias("rep"), F.col("component").alias("c1"))
    to = larger.select("path", "rep").join(of_path, "path").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_set("centres"))).alias("centres")).join(own, "rep", "left")
    open_ = F.filter("centres", lambda c: (c.comp != F.coalesce("c1", "rep")) & (c.centre != F.col("rep")))
    apart = to.select("rep", F.explode(F.transform(open_, lambda c: c.centre)).alias("centre"))
    met = apart.hint("merge").join(sketches, "rep").join(sketches.select(F.col("rep").alias("centre"), F.col("sketch").alias("of_centre")), "centre")
    near = stage(tx.arrow_map(met.select("rep", "centre", "sketch", "of_centre"), _near_pairs(threshold), "rep long, centre long"), "centres")
    both = near.select(F.xxhash64("rep", "centre").alias("node"), F.explode(F.array("rep", "centre")).alias("rep"))
    more = _compared(both, docs, width, threshold, "centres")
    found = [found, more]
    labels = _merged(labels, more).withColumnRenamed("node", "rep")
    if residual:
        rest = _open(large.select("path", "rep"), labels, sketches, threshold)
        reps_of = stage(_sharing(rest, docs, width, threshold), "sharing")
        met = reps_of.select(F.xxhash64("reps").alias("node"), F.explode("reps").alias("rep")).hint("merge").join(sketches, "rep").select("node", "rep", "sketch")
        last = stage(tx.arrow_map(met.repartition(partitions(spark), "node").sortWithinPartitions("node", "rep"), _likely(threshold), "node long, reps array<long>, centre long, degree double"), "likely")
        parts = last.where("reps IS NOT NULL").select("reps").distinct().select(F.xxhash64("reps").alias("node"), F.explode("reps").alias("rep"))
        found.append(_compared(parts, docs, width, threshold, "residual"))
        labels = _merged(labels.withColumnRenamed("rep", "node"), found[-1]).withColumnRenamed("node", "rep")
        unstage(reps_of, last)
    unstage(*held, likely, near, *found)
    out = rows.drop("sig", "sketch").join(labels, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (of several, that of the least text hash).

    Rows with a null id all stay. Other columns may have any name that does
    not begin with ``__``.
    """
    by_id = link(docs, width, threshold, text, key).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__again"), F.count(F.lit(1)).alias("__times"))
    # ids that go, and those of which one row of several stays; the rows of most others are not shuffled
    marked = stage(by_id.where("NOT __again OR __times > 1").select("__id", "__again"), "marked")
    rows = tx.sifted(docs.withColumn("__key", F.col(key).cast("long")), "__key", marked, "__id")
    other = rows.where("__maybe").join(marked, F.col("__key") == F.col("__id"), "left_anti")
    out = rows.where("NOT __maybe").select(*docs.columns).unionByName(other.select(*docs.columns))
    if not marked.where("__again").limit(1).count():
        return out
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(text), text))
    again = rows.where("__maybe").join(marked.where("__again"), F.col("__key") == F.col("__id")).withColumn("__first", first)
    return out.unionByName(again.where("__first = 1").select(*docs.columns))


def recall_at(similarity: float, threshold: int = THRESHOLD, level: int | None = None) -> float:
    """Chance that a pair of this similarity meets at a level (the last one) of one tree at least."""
    more, apart = 100 / threshold - 1, 0.0
    for _ in range(level or DEPTH):
        lost = 1 - similarity * (1 - apart)
        apart = lost * (1 - more + more * lost)
    return 1 - math.pow(apart, TREES)
