"""Dense groups: hubs, several hubs, chains and templates, against brute force or a known answer."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from glossa.llm import neardup


def edited(base, rng, n, tag):
    w = list(base)
    for k in rng.sample(range(len(base)), n):
        w[k] = f"{tag}_{k}"
    return " ".join(w)


def components(spark, rows, width=3, threshold=85):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return {r.doc_id: r.component_id for r in neardup.link(df, width, threshold).collect()}


def test_every_spoke_reaches_its_hub(spark):
    """Texts that are linked to a hub of a large id, and hardly to one another; two hubs in one node, and texts apart."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    other = [f"v{i}" if i % 4 == 0 else w for i, w in enumerate(base)]
    rows = [(1_000_000, " ".join(base)), (2_000_000, " ".join(other))]
    rows += [(i, edited(base, rng, 5, f"a{i}")) for i in range(1, 1500)] + [(i, edited(other, rng, 5, f"b{i}")) for i in range(5000, 5400)]
    rows += [(i, " ".join(f"z{i}_{k}" for k in range(60))) for i in range(9000, 9050)]
    got = components(spark, rows)
    assert {got[i] for i in (*range(1, 1500), 1_000_000)} == {1}
    assert {got[i] for i in (*range(5000, 5400), 2_000_000)} == {5000}
    assert all(got[i] == i for i in range(9000, 9050))


def test_graded_chains_in_a_dense_node_hold_together(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows, want = [], {}
    for c in range(40):
        w, first = edited(base, rng, 12, f"c{c}").split(), 100 * c
        for i in range(8):
            for k in rng.sample(range(300), 6):
                w[k] = f"d{c}_{i}_{k}"
            rows.append((first + i, " ".join(w)))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(3)), strict=False)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * (k := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: find(i) for i in sets}
    assert components(spark, rows) == want and len(set(want.values())) < len(rows)


def brute(node, rep, x, least):
    return {(int(node[i]), frozenset((int(rep[i]), int(rep[j])))) for i in range(len(node)) for j in range(i) if node[i] == node[j] and rep[i] != rep[j] and (x[i] == x[j]).sum() >= least}


def batches(table, sizes):
    at = 0
    for n in sizes:
        yield from table.slice(at, n).combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], table.schema)]
        at += n


def test_nodes_are_whole_however_rows_are_batched():
    rng = np.random.default_rng(1)
    node = np.sort(rng.integers(0, 60, 900))
    rep = rng.integers(0, 40, 900)
    order = np.lexsort((rep, node))
    node, rep = node[order], rep[order]
    kinds = rng.integers(0, 256, (40, neardup.COORDINATES)).astype(np.uint8)
    kinds[20:] = kinds[:20]
    kinds[20:, : 64 - neardup._cut(85) + 1] += 1
    kinds[30:, 0] -= 1
    x = kinds[rep]
    want = brute(node, rep, x, neardup._cut(85))
    table = pa.table({"node": node, "rep": rep, "sketch": pa.array([r.tobytes() for r in x], pa.binary())})
    comp = rep % 7
    mixed = pa.table({"node": node, "rep": rep, "comp": comp, "sketch": table["sketch"]})
    apart = {r for n, e in want for r in e if len({i % 7 for i in e}) > 1}
    for sizes in ([900], [1] * 900, [0, 3, 400, 0, 100, 397], list(rng.multinomial(900, [0.02] * 50))):
        got, pairs = set(), set()
        for b in neardup._likely(85)(batches(table, sizes)):
            for r in b.to_pylist():
                if r["reps"]:
                    got.add((r["node"], tuple(r["reps"])))
        for n in set(node.tolist()):
            ids, parent = sorted(set(rep[node == n].tolist())), {}
            parent = {i: i for i in ids}
            for m, e in want:
                if m == n:
                    a, b = sorted(e)
                    low, high = sorted((parent[a], parent[b]))
                    parent = {k: low if v == high else v for k, v in parent.items()}
            for p in set(parent.values()):
                own = tuple(i for i in ids if parent[i] == p)
                if len(own) > 1:
                    pairs.add((n, own))
        assert got == pairs
        assert {i for b in neardup._apart(85)(batches(mixed, sizes)) for i in b.column(0).to_pylist()} == apart


def test_links_are_exact_however_texts_are_batched():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = {i: edited(base, rng, i % 4, f"t{i % 9}") for i in range(60)}
    rows = sorted((n, i, texts[i]) for n in range(40) for i in rng.sample(range(60), rng.choice((2, 2, 3, 9))))
    rows += [rows[-1]]
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(3)), strict=False)) for i, t in texts.items()}
    linked = lambda a, b: 100 * (k := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - k)
    table = pa.table({"node": [r[0] for r in rows], "rep": [r[1] for r in rows], "text": [r[2] for r in rows]})
    for sizes in ([len(rows)], [1] * len(rows), [7] * (len(rows) // 7 + 1)):
        found = {tuple(sorted(e)) for b in neardup._compare(3, 85)(batches(table, sizes)) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        for n in {r[0] for r in rows}:
            ids = sorted({r[1] for r in rows if r[0] == n})
            for a in ids:
                for b in ids:
                    if a < b and linked(a, b):
                        front, seen = [a], {a}
                        while front:
                            c = front.pop()
                            more = {y for e in found for x, y in (e, e[::-1]) if x == c} - seen
                            seen |= more
                            front += more
                        assert b in seen
