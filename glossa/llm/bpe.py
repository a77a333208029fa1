"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves. Any other pre-token is merged over a linked list of its
bytes with a heap of candidate pairs, so it costs O(n log n) at any length.
Texts are cut first at white space into runs that the pre-token pattern
splits each on its own; a run's ids are remembered in two bounded
generations, which a worker keeps until its partition ends.

Ids travel as little-endian unsigned 32-bit integers.

Defined cases: a null text is an empty one and has no ids; repeated texts give
equal ids; special tokens' strings are ordinary text; a lone very long
pre-token is merged whole; an id outside the vocabulary raises an error on
decoding; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx

#: The code points of Unicode's White_Space property.
SPACES = "\t-\r \x85\xa0  -     　"
#: Runs on which the pattern works independently: white space, or other text with one space before it.
RUNS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
GENERATION = 200_000


class MinimalPerfectHash:
    """Maps the n given keys to 0..n-1 without gaps: hash, displace by bucket, compress."""

    def __init__(self, keys: list[bytes], load: int = 2):
        n = max(1, len(keys))
        self.slots, self.buckets = n, max(1, n // load)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for at, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups[h % self.buckets].append((at, h))
        self.pilots = np.zeros(self.buckets, np.int64)
        owner = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            group = groups[b]
            if not group:
                break
            if len(group) > 1:
                pilot = 1
                while len(set(spots := [self._slot(h, pilot) for _, h in group])) < len(group) or any(owner[s] >= 0 for s in spots):
                    pilot += 1
                self.pilots[b] = pilot
            else:
                free = free or iter([s for s in range(n) if owner[s] < 0])
                spots = [next(free)]
                self.pilots[b] = -spots[0] - 1
            for s, (at, _) in zip(spots, group, strict=True):
                owner[s] = at
        self.owner = np.array(owner, np.int64)

    def _slot(self, h: int, pilot: int) -> int:
        x = (h ^ (pilot * 0x9E3779B97F4A7C15)) & tx.MASK64
        return (((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & tx.MASK64) >> 31) % self.slots

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        pilot = self.pilots_list[h % self.buckets]
        return -pilot - 1 if pilot < 0 else self._slot(h, pilot)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pilots_list"}

    def __getattr__(self, name):
        if name == "pilots_list":
            self.pilots_list = self.pilots.tolist()
            return self.pilots_list
        raise AttributeError(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = sorted(ranks, key=ranks.get)
        self.hash = MinimalPerfectHash(self.tokens)
        self._ready()

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "tokens": self.tokens, "hash": self.hash}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self):
        self.split = regex.compile(self.pattern).findall
        at = self.hash.owner.tolist()
        self.keys = [self.tokens[i] for i in at]
        self.ids = [self.ranks[k] for k in self.keys]
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.young, self.old = _Young(self), {}

    def forget(self) -> None:
        """Drops the remembered runs."""
        self.young.clear()
        self.old = {}

    def lookup(self, token: bytes) -> int:
        """First tier: the id of a pre-token that is in the vocabulary, else -1."""
        s = self.hash.slot(token)
        return self.ids[s] if self.keys[s] == token else -1

    def merge(self, word: bytes) -> list[int]:
        """Second tier: merge the lowest ranked, leftmost pair until none has a rank."""
        n, ranks = len(word), self.ranks
        if n == 1:
            return [ranks[word]]
        rank, pop, push = ranks.get, heapq.heappop, heapq.heappush
        shift = n.bit_length()
        mask, top = (1 << shift) - 1, 2 * shift
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << top | i << shift | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            stop, i = x & mask, x >> shift & mask
            j = end[i]
            if not j or j == n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                if (r := rank(word[i:after], -1)) >= 0:
                    push(heap, r << top | i << shift | after)
            p = before[i]
            if p >= 0 and (r := rank(word[p:stop], -1)) >= 0:
                push(heap, r << top | p << shift | stop)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[word[i:j]])
            i = j
        return out

    def run(self, text: str) -> bytes:
        """Ids of one run between white space; its pre-tokens are runs too, and remembered alike."""
        if not (text[1:] if text[0] == " " and len(text) > 1 else text).isalpha():
            parts = self.split(text)
            if len(parts) > 1:
                return b"".join(map(self.young.__getitem__, parts))
        raw = text.encode()
        at = self.lookup(raw)
        out = [at] if at >= 0 else self.merge(raw)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.young.__getitem__, RUNS.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Young(dict):
    """Runs and their ids; when full it becomes the old generation, from which used runs return."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, run: str) -> bytes:
        codec = self.codec
        if len(self) >= GENERATION:
            codec.old = dict(self)
            self.clear()
        ids = codec.old.get(run)
        if ids is None:
            ids = codec.run(run)
        if len(run) <= 64:
            self[run] = ids
        return ids


def _each(docs: DataFrame, codec: Codec, text: str, keep: tuple[str, ...], columns: str, row) -> DataFrame:
    """``keep`` and what ``row`` makes of each text; the codec is broadcast, its size is the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [tuple(c.split()) for c in columns.split(", ")]

    def run(batches):
        own = shared.value
        for batch in batches:
            rows = [row(own, t) for t in tx.texts(batch.column(len(keep)))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True))], [*keep, *(n for n, _ in fields)])
        own.forget()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return tx.arrow_map(docs.select(*keep, F.col(text).alias("__text")), run, f"{schema}, {columns}")


def encode(docs: DataFrame, codec: Codec, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` (binary) of every text."""

    def row(own, t):
        ids = own.encode(t)
        return len(ids) // 4, ids

    return _each(docs, codec, text, keep, "n_tokens long, ids binary", row)


def digests(docs: DataFrame, codec: Codec, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, token counts and the digests of the ids and of the bytes decoded from them."""

    def row(own, t):
        ids = own.encode(t)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _each(docs, codec, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def decode(encoded: DataFrame, codec: Codec, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the decoded ``data`` (binary) of every row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([own.decode(x or b"") for x in batch.column(len(keep)).to_pylist()], pa.binary())], [*keep, "data"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return tx.arrow_map(encoded.select(*keep, F.col(ids).alias("__ids")), run, f"{schema}, data binary")
