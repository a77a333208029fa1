"""The suffix tree against a plain one that holds all counts in dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import suffixtree as st


def corpus(n=300, seed=5):
    """Texts with words that follow one another, in one and in two words' distance, and words of their own."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, a, b = [], 0, 0
        for _ in range(rng.randrange(60)):
            c = (3 * b + a) % 11 if rng.random() < 0.6 else rng.randrange(40) if rng.random() < 0.9 else 1000 + rng.randrange(4000)
            a, b = b, c
            words.append(f"W{c}" if rng.random() < 0.1 else f"w{c}")
        out.append((i, " ".join(words)))
    return [*out, (None, "w1 w2 w3"), (n, None), (n + 1, ""), (n + 1, "w4  w8\tw9"), (n + 2, "zz " * 3000)]


def plain(rows, held):
    texts = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    learn = [s for i, s in texts if not held(i)]
    count = Counter(w for s in learn for w in s)
    total, distinct = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
    after = defaultdict(Counter)
    for s in learn:
        for i, w in enumerate(s):
            for d in range(1, min(i, st.DEPTH) + 1):
                after[tuple(s[i - d : i])][w] += 1
    kept, rest = {}, {}

    def state(ctx):
        while ctx and ctx not in kept:
            ctx = ctx[1:]
        return ctx

    def prob(ctx, w):
        if not ctx:
            return base(w)
        return kept[ctx][w] if w in kept[ctx] else rest[ctx] * prob(state(ctx[1:]), w)

    for depth in range(1, st.DEPTH + 1):
        level = {}
        for ctx in (c for c in after if len(c) == depth):
            n = sum(after[ctx].values())
            own = {w: (c - st.DISCOUNT) / n for w, c in after[ctx].items() if c >= st.GAMMA * n}
            above = {w: prob(state(ctx[1:]), w) for w in own}
            left, left_above = 1 - sum(own.values()), 1 - sum(above.values())
            if n < st.least(total) or not own or left <= 1e-9 or left_above <= 1e-9:
                continue
            gain = sum(p * math.log(p / above[w]) for w, p in own.items()) + left * math.log(left / left_above)
            if gain >= st.DIVERGENCE and gain * n >= st.EVIDENCE:
                level[ctx] = own, left / left_above
        for ctx, (own, more) in level.items():
            kept[ctx], rest[ctx] = own, more
    scores = [sum(math.log10(prob(state(tuple(s[max(0, i - st.DEPTH) : i])), w)) for i, w in enumerate(s)) for _, s in texts]
    return [(i, v) for (i, _), v in zip(texts, scores, strict=True)], kept


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scores_are_those_of_a_plain_tree(spark, parts):
    rows = corpus()
    want, kept = plain(rows, lambda i: i is not None and i % 5 == 1)
    assert {len(c) for c in kept} >= {1, 2}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).repartition(parts, "text")
    got = st.score(df, F.col("doc_id") % 5 == 1).collect()
    a, b = (sorted(((-1 if i is None else i), v) for i, v in x) for x in (want, [(r.doc_id, r.score) for r in got]))
    assert [i for i, _ in a] == [i for i, _ in b] and all(math.isclose(x, y, rel_tol=1e-9) for (_, x), (_, y) in zip(a, b, strict=True))


def test_the_tree_grows_with_the_corpus():
    assert [st.least(n) for n in (0, 10_000, 10**6)] == [2, 2, 200]
    shares = [st.least(n) / n for n in (10**7, 10**8, 10**9, 10**10)]
    assert shares == sorted(shares, reverse=True) and shares[0] > 25 * shares[-1]
    assert st.least(10**13) == 10**13 // st.STATES


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in st.score(df, F.lit(True)).collect()}
    assert (got[1].n_known, got[1].train_tokens, got[2].n_tokens) == (0, 0, 1) and math.isclose(got[1].score, 0.0, abs_tol=1e-9)
