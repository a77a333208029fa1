"""Toxicity by a linear-chain conditional random field.

Tokens are runs of letters and digits, A-Z in lower case. A lexicon of words
that mark toxic documents is learned from a sample of labelled rows; a token
of a toxic document is labelled toxic if its word is in the lexicon. The field
has two states, weights for the lexicon's words and for any other word, and
transitions; it is trained on the labelled tokens by its exact gradient.
Forward-backward marginals give each token's chance of being toxic. Words
outside the lexicon share one potential, so stretches of them are powers of
one matrix in closed form and the whole text costs steps only at lexicon
words. A document's score is a logistic function of its expected number of
toxic tokens, its largest marginal and its length, fitted on the sample and
set to the classes' odds among all labelled rows.

The sample has about ``SAMPLE`` labelled rows of either class (all of a rarer
one), taken by a hash of the id; the lexicon holds at most ``LEXICON`` words.

Defined cases: a null text is an empty one, scored like any text without
lexicon words; null labels and labels of absent documents are not used;
repeated labels or rows count each time; without labels of both classes every
score is 0.5 less a little; texts are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.runtime import stage, unstage

#: ``MIN_Z`` and ``MIN_ODDS`` choose the lexicon; ``LEXICON`` only keeps its numbers within 16 bits.
SAMPLE, LEXICON, MIN_DOCS, MIN_Z, MIN_ODDS = 2000, 30_000, 3, 4.5, 3.0
WINDOW, STEPS, RATE, PENALTY = 48, 150, 0.5, 1e-4
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _distinct(batches):
    for batch in batches:
        words = [sorted(set(tokens(t))) for t in tx.texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["toxic", "words"])


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[bytes]:
    """Words whose presence speaks for a toxic document, strongest first."""
    words = tx.arrow_map(sample.select("toxic", "text"), _distinct, "toxic int, words array<binary>").select("toxic", F.explode("words").alias("w"))
    seen = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= MIN_DOCS)
    t, c = F.col("t"), F.col("n") - F.col("t")
    odds = F.log((t + 0.5) / (n_toxic + 0.5 - t)) - F.log((c + 0.5) / (n_clean + 0.5 - c))
    share = n_toxic / (n_toxic + n_clean)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * F.lit(p)))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(part(t, share) + part(c, 1 - share), F.lit(0.0)))
    rated = seen.select("w", odds.alias("odds"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
    return [bytes(r.w) for r in rated.orderBy(F.desc("z"), "w").limit(LEXICON).collect()]


def _windows(sequences: list[tuple[int, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (word numbers, labels, weights) of texts given as length, places and numbers of lexicon words, and label.

    Whole windows of other words only are alike: one stands for all of them, weighted.
    """
    x, y, cold = [np.zeros((0, WINDOW), np.int64)], [np.zeros(0, bool)], 0
    for n, at, ids, toxic in sequences:
        hot, place = np.unique(at // WINDOW, return_inverse=True)
        part = np.zeros((len(hot), WINDOW), np.int64)
        part[place, at % WINDOW] = ids
        part[hot[:, None] * WINDOW + np.arange(WINDOW) >= n] = -1
        x.append(part)
        y.append(np.full(len(hot), bool(toxic)))
        cold += n // WINDOW - int((hot < n // WINDOW).sum())
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.ones(len(x))
    if cold:
        x, y, weight = np.vstack([x, np.zeros((1, WINDOW), np.int64)]), np.append(y, False), np.append(weight, cold)
    return x, ((x > 0) & y[:, None]).astype(np.int64), weight


def _train(sequences: list[tuple[int, np.ndarray, np.ndarray, int]], size: int) -> dict:
    """Weights of the field from windows of tokens (0: any other word) and their documents' labels."""
    x, y, weight = _windows(sequences)
    real = x >= 0
    emit, trans = np.zeros(size + 1), np.zeros((2, 2))
    emit[0] = -3.0
    if not len(x):
        return {"emit": emit, "trans": trans}
    ve, vt = np.zeros_like(emit), np.zeros_like(trans)
    wide = np.broadcast_to(weight[:, None], x.shape)
    gold_e = np.bincount(x[real], weights=(wide * y)[real], minlength=size + 1)
    both = real[:, 1:] & real[:, :-1]
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), wide[:, 1:][both])
    total = np.maximum(1.0, np.bincount(x[real], weights=wide[real], minlength=size + 1))
    for _ in range(STEPS):
        pot = np.ones((*x.shape, 2))
        pot[..., 1] = np.where(real, np.exp(np.clip(emit[np.maximum(x, 0)], -30, 30)), 1)
        m = np.exp(trans)
        a, b = np.empty_like(pot), np.ones_like(pot)
        a[:, 0] = pot[:, 0] / pot[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            v = (a[:, t - 1] @ m) * pot[:, t]
            v = np.where(real[:, t : t + 1], v, a[:, t - 1])
            a[:, t] = v / v.sum(axis=1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            v = (b[:, t + 1] * pot[:, t + 1]) @ m.T
            v = np.where(real[:, t + 1 : t + 2], v, b[:, t + 1])
            b[:, t] = v / v.sum(axis=1, keepdims=True)
        p = a * b
        p /= p.sum(axis=2, keepdims=True)
        pair = a[:, :-1, :, None] * m * (b * pot)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        model_e = np.bincount(x[real], weights=(wide * p[..., 1])[real], minlength=size + 1)
        model_t = (pair * (wide[:, 1:] * both)[..., None, None]).sum(axis=(0, 1))
        ve = 0.9 * ve + RATE * ((gold_e - model_e) / total - PENALTY * emit)
        vt = 0.9 * vt + RATE * ((gold_t - model_t) / max(1.0, gold_t.sum()) - PENALTY * trans)
        emit, trans = emit + ve, trans + vt
    return {"emit": emit, "trans": trans}


class Field:
    """A trained field: marginals at lexicon words, and expectations over whole texts."""

    def __init__(self, lexicon: list[bytes], weights: dict, head: np.ndarray):
        self.place = {w: i + 1 for i, w in enumerate(lexicon)}
        self.emit, self.m = np.exp(np.clip(weights["emit"], -30, 30)), np.exp(weights["trans"])
        self.head = head
        step = self.m * np.array([1.0, self.emit[0]])  # a move to an other word
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        self.ratio, inverse = values[1] / values[0], np.linalg.inv(vectors)
        self.first = np.outer(vectors[:, 0], inverse[0])
        self.second = np.outer(vectors[:, 1], inverse[1])
        start = np.array([1.0, self.emit[0]])
        self.start, self.end = start / start.sum(), np.ones(2)

    def _power(self, n: int) -> np.ndarray:
        """The n-th power of the move to an other word, up to scale."""
        return self.first + self.second * self.ratio**n

    def marginals(self, length: int, at: list[int], words: list[int]) -> np.ndarray:
        """Chance of being toxic for the lexicon words ``words`` at the positions ``at`` of a text."""
        k = len(at)
        before, after = np.empty((k, 2)), np.empty((k, 2))
        v = None
        for i in range(k):
            own = np.array([1.0, self.emit[words[i]]])
            if i == 0:
                v = own if at[0] == 0 else ((self.start @ self._power(at[0] - 1)) @ self.m) * own
            else:
                gap = at[i] - at[i - 1] - 1
                v = ((v @ self._power(gap) if gap else v) @ self.m) * own
            v = np.maximum(v, 1e-300)
            v = before[i] = v / v.sum()
        u = self._power(length - 1 - at[-1]) @ self.end if at[-1] < length - 1 else self.end
        for i in range(k - 1, -1, -1):
            after[i] = u = np.maximum(u, 1e-300) / max(u.sum(), 1e-300)
            if i:
                u = self.m @ (np.array([1.0, self.emit[words[i]]]) * u)
                gap = at[i] - at[i - 1] - 1
                if gap:
                    u = self._power(gap) @ u
        p = before * after
        return p[:, 1] / p.sum(axis=1)

    def read(self, text: str) -> tuple[int, list[int], np.ndarray]:
        """Number of tokens, positions of lexicon words and their marginals."""
        ws, place = tokens(text), self.place
        at = [i for i, w in enumerate(ws) if w in place]
        return len(ws), at, self.marginals(len(ws), at, [place[ws[i]] for i in at]) if at else np.zeros(0)

    def features(self, text: str) -> tuple[float, ...]:
        n, _, p = self.read(text)
        return 1.0, math.log1p(float(p.sum())), float(p.max()) if len(p) else 0.0, float(p.sum()) / max(1, n), math.log1p(n) * (float(p.max()) if len(p) else 0.0)

    def score(self, text: str) -> float:
        z = float(np.dot(self.features(text), self.head))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, marginal) in code points of the tokens that are toxic with chance ``least`` or more."""
        _, at, p = self.read(text)
        hot = {i: float(q) for i, q in zip(at, p, strict=True) if q >= least}
        return [(*m.span(), hot[i]) for i, m in enumerate(_TOKEN.finditer(text)) if i in hot] if hot else []


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for an L2-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Field:
    """The field, from about ``sample`` labelled rows of either class among those where ``learn`` holds."""
    rows = labels.where(learn).select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).where("toxic IN (0, 1) AND id IS NOT NULL")
    have = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {k: min(1.0, sample / max(1, have.get(k, 0))) for k in (0, 1)}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    chosen = rows.where(draw < F.when(F.col("toxic") == 1, math.ceil(n[1] * (1 << 20))).otherwise(math.ceil(n[0] * (1 << 20))))
    # the sample is bounded, about 2 * sample rows
    taken = stage(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "toxic", "text"), "toxic")
    got = {r.toxic: r.n for r in taken.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = _lexicon(taken, got.get(1, 0), got.get(0, 0)) if got.get(1) and got.get(0) else []
    place = {w: i + 1 for i, w in enumerate(lexicon)}

    def number(batches):
        for batch in batches:
            ids = [np.array([place.get(w, 0) for w in tokens(t)], "<i2") for t in tx.texts(batch.column(1))]
            at = [np.flatnonzero(x) for x in ids]
            cols = [len(x) for x in ids], [a.astype("<i4").tobytes() for a in at], [x[a].tobytes() for x, a in zip(ids, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["toxic", "n", "at", "ids"])

    # of each sampled text the driver gets its length and lexicon words
    packed = sorted((r.toxic, r.n, bytes(r.at), bytes(r.ids)) for r in tx.arrow_map(taken.select("toxic", "text"), number, "toxic int, n long, at binary, ids binary").collect())
    unstage(taken)
    sequences = [(n, np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<i2").astype(np.int64), t) for t, n, a, b in packed]
    field = Field(lexicon, _train(sequences, len(lexicon)), np.zeros(5))
    x, y = [], []
    for n, at, ids, t in sequences:
        p = field.marginals(n, at.tolist(), ids.tolist()) if len(at) else np.zeros(0)
        top = float(p.max()) if len(p) else 0.0
        x.append((1.0, math.log1p(float(p.sum())), top, float(p.sum()) / max(1, n), math.log1p(n) * top))
        y.append(t)
    if x:
        field.head = _logistic(np.array(x), np.array(y, float))
        if got.get(1) and got.get(0):  # the classes' odds among all labelled rows, not those in the sample
            field.head[0] += math.log(have[1] / got[1]) - math.log(have[0] / got[0])
    return field


def score(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score``, ``predicted`` and the toxic ``spans`` (start, end, chance) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = tx.texts(batch.column(len(keep)))
            scores = [own.score(t) for t in texts]
            spans = [[dict(zip(("start", "end", "chance"), s, strict=True)) for s in own.spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)], [*keep, "score", "predicted", "spans"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return tx.arrow_map(docs.select(*keep, F.col(text).alias("__text")), run, f"{schema}, score double, predicted int, spans array<struct<start:long,end:long,chance:double>>")
