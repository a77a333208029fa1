"""Language identification by hierarchical discrimination.

The family of languages is predicted first; linear support vector machines,
one for each pair of the family's languages, then vote within it. Features are
hashed byte trigrams of the text with A-Z in lower case and ASCII non-letters
as spaces, as a share of the text's trigrams. Weights are integers, so a
text's margin is an exact sum and equal texts score alike wherever they lie.

Training takes a hash sample of about ``per_language`` labelled rows of each
language (all rows of a rarer one); prediction reads every whole text.

Defined cases: a null text, or one without a letter, gives ``und`` and score
0; texts with letters but no trigram take the machines' biases; repeated rows
and tied votes give the same answer each time (the language first in code
point order wins a tie); an empty table, or one without labels, gives ``und``
for every row; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx

#: Language families by ISO 639-1 code. Those not named are one family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
BUCKETS = 4096
PER_LANGUAGE = 800
#: Languages that are learned, the most frequent ones; bounds the machines, one for each pair of a family.
LANGUAGES = 64
#: The family of languages that are in no other.
OTHERS = "others"
UND = "und"
#: Integer weights are real ones times this.
SCALE = 1 << 20
RATE, PENALTY, STEPS = 0.5, 1e-3, 80
#: Rows of a batch that are predicted at once.
SLICE = 1000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), OTHERS)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte but the last two."""
    d = _FOLD[data].astype(np.uint32)
    code = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(20)


def _pieces(lo: int, hi: int):
    """The bytes [lo, hi) in pieces that overlap by two, so each trigram falls in one."""
    while hi - lo > 2:
        yield lo, min(hi, lo + tx.BLOCK_BYTES + 2)
        lo += tx.BLOCK_BYTES


def row_sums(off: np.ndarray, data: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the sums of every machine's weights over its trigrams, and their number."""
    rows = len(off) - 1
    sums, count = np.zeros((rows, len(weights)), np.int64), np.maximum(np.diff(off) - 2, 0)
    for i, j in tx.row_blocks(np.diff(off), tx.BLOCK_BYTES):
        if j - i == 1:
            for lo, hi in _pieces(off[i], off[j]):
                idx = trigrams(data[lo:hi])
                sums[i] += weights[:, idx].sum(axis=1, dtype=np.int64)
        elif off[j] - off[i] > 2:
            idx, n = trigrams(data[off[i] : off[j]]), count[i:j]
            lo = np.minimum(off[i:j] - off[i], len(idx))
            for k, w in enumerate(weights):
                total = np.concatenate([[0], np.cumsum(w[idx], dtype=np.int64)])
                sums[i:j, k] = np.where(n > 0, total[np.minimum(lo + n, len(idx))] - total[lo], 0)
    return sums, count


def _features(batches):
    for batch in batches:
        off, data = tx.utf8_buffer(batch.column(1))
        buckets, shares = [], []
        for i in range(len(batch)):
            counts = np.zeros(BUCKETS, np.int64)
            for lo, hi in _pieces(off[i], off[i + 1]):
                counts += np.bincount(trigrams(data[lo:hi]), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            buckets.append(at.astype("<u2").tobytes())
            shares.append((counts[at] / max(1, counts.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["lang", "buckets", "shares"])


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighing the same."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v, bias, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for _ in range(STEPS):
        g = cost * y * np.maximum(0, 1 - y * (x @ w + bias))
        v = 0.9 * v + RATE * (g @ x - PENALTY * w)
        vb = 0.9 * vb + RATE * 0.1 * float(g.sum())
        w, bias = w + v, bias + vb
    return w, bias


def _one_versus_one(x, labels: np.ndarray, scale: np.ndarray) -> list:
    """(first, second, integer weights, bias) for each pair of classes; positive means the first."""
    out, names = [], sorted(set(labels.tolist()))
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            at = np.flatnonzero((labels == a) | (labels == b))
            w, bias = _machine(x[at], np.where(labels[at] == a, 1, -1).astype(np.float32))
            out.append((a, b, np.rint(w * scale * SCALE).astype(np.int64), bias))
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> dict:
    """The machines, learned from a hash sample of the labelled rows.

    The sample has about ``per_language`` rows of each of the ``languages``
    most frequent languages, so its size does not follow the table's.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 20)).alias("draw")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return {"langs": [], "families": [], "pairs": {}}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, math.ceil(min(1.0, per_language / n) * (1 << 20)))])
    sample = rows.where(F.col("draw") < share[F.col("lang")]).select("lang", "text")
    got = tx.arrow_map(sample, _features, "lang string, buckets binary, shares binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.buckets), bytes(r.shares)))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.buckets, "<u2")] = np.frombuffer(r.shares, "<f4")
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
    x *= scale
    lang = np.array([r.lang for r in got], dtype=object)
    family = np.array([family_of(v) for v in lang], dtype=object)
    return {
        "langs": sorted(counts),
        "families": _one_versus_one(x, family, scale),
        "pairs": {f: _one_versus_one(x[family == f], lang[family == f], scale) for f in sorted(set(family))},
    }


def _vote(names: list[str], machines: list, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner in ``names`` and its weakest margin, by row."""
    votes, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
    for k, (a, b, _, _) in enumerate(machines):
        i, j, m = names.index(a), names.index(b), margins[:, k]
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
    win = votes.argmax(axis=1)
    return win, least[np.arange(len(win)), win]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def predictor(model: dict):
    machines = model["families"] + [m for f in sorted(model["pairs"]) for m in model["pairs"][f]]
    weights = np.stack([m[2] for m in machines]).astype(np.int64) if machines else np.zeros((0, BUCKETS), np.int64)
    bias = np.array([m[3] for m in machines])
    langs = {f: sorted(v for v in model["langs"] if family_of(v) == f) for f in sorted({family_of(v) for v in model["langs"]})}

    def predict(off: np.ndarray, data: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(off) - 1
        if not langs:
            return [UND] * rows, np.zeros(rows)
        sums, count = row_sums(off, data, weights)
        margins = sums / SCALE / np.maximum(count, 1)[:, None] + bias
        families = list(langs)
        at = len(model["families"])
        win, least = _vote(families, model["families"], margins[:, :at])
        pred, score = np.empty(rows, object), _sigmoid(3 * least)
        for i, f in enumerate(families):
            own = model["pairs"].get(f, [])
            inner, strength = _vote(langs[f], own, margins[:, at : at + len(own)])
            at += len(own)
            here = win == i
            pred[here] = np.array(langs[f], object)[inner[here]]
            score[here] *= _sigmoid(3 * strength[here])
        pred[~letters], score[~letters] = UND, 0.0
        return pred.tolist(), score

    return predict


def identify(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, the predicted language and its score (called ``names``) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANGUAGES bounds its size
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = keep if text in keep else (*keep, text)

    def run(batches):
        predict = predictor(shared.value)
        for whole in batches:
            for lo in range(0, len(whole), SLICE):
                batch = whole.slice(lo, SLICE)
                col = batch.column(read.index(text))
                letters = np.fromiter((any(map(str.isalpha, t)) for t in tx.texts(col)), bool, len(col))
                pred, score = predict(*tx.utf8_buffer(col), letters)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    return tx.arrow_map(docs.select(*read), run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def with_language(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the rows where ``learn`` holds, then predict every row."""
    return identify(docs, fit(docs.where(learn), text, lang, key), text, keep)
