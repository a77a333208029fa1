"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for assignments, access keys, hex strings (the base
kinds) and for further candidates (vendor tokens, web tokens, mixed strings of
high entropy). Candidate values are hashed, and the hashes aggregated over the
corpus by distinct repositories (documents) and owners. A value under at most
``MAX_OWNERS`` owners that looks live is owner-specific; one under more owners
is a widely copied example. Base spans always stay; further candidates become
spans only where they are owner-specific and look live. Base kinds are not held
to the length and digits that further candidates need to look live.

Counts by hash are built in three aggregations (by hash, owner and repository;
by hash and owner; by hash), each combined before its shuffle, so a value that
a third of all rows hold costs a row for each task. Texts are never shuffled.

Defined cases: a null text is an empty one and has no spans; a null owner
counts as one owner, a null id as one repository; repeated rows count once and
each returns the same spans; values that overlap a base span are not added;
texts are scanned whole at any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx
from glossa.runtime import stage

#: The kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "vendor", "jwt", "entropy")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
VENDOR = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
MIN_VALUE, MIN_ENTROPY, MIN_BASE_ENTROPY, MAX_OWNERS = 8, 3.0, 2.0, 1


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Long and mixed enough for a credential, and no repetition or placeholder."""
    return len(value) >= 16 and sum(map(str.isdigit, value)) >= 2 and any(map(str.isalpha, value)) and entropy(value) >= MIN_ENTROPY


def base_looks_live(value: str) -> bool:
    """For the base kinds, whose pattern or name already tells a credential: no repetition."""
    return len(value) >= MIN_VALUE and entropy(value) >= MIN_BASE_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, leftmost and non-overlapping by kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def further_spans(text: str, base: list) -> list[tuple[int, int, str, str]]:
    """Further candidates that overlap neither a base span nor one another."""
    taken, out = [x[:2] for x in base], []
    for kind, pattern in (("vendor", VENDOR), ("jwt", JWT), ("entropy", MIXED)):
        for m in pattern.finditer(text):
            if (kind != "entropy" or sum(map(str.isdigit, m[0])) >= 3) and looks_live(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken):
                taken.append(m.span())
                out.append((*m.span(), kind, m[0]))
    return sorted(out)


SPAN = pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string()), ("live", pa.bool_())])


def _scan(batches):
    for batch in batches:
        spans, digest, counts = [], [], []
        for t in tx.texts(batch.column(3)):
            base = base_spans(t)
            spans.append([{"start": s, "ord": KINDS.index(k), "end": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": (base_looks_live if k in BASE else looks_live)(v)} for s, e, k, v in base + further_spans(t, base)])
            digest.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k, _ in base).encode()).hexdigest())
            counts.append(Counter(x[2] for x in base))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE), pa.array(digest, pa.string()), pa.array(spans, pa.list_(SPAN))],
            ["repo", "owner", "print", *(f"n_{k}" for k in BASE), "base_sha256", "found"],
        )


def scan(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Every row's candidates, without its text."""
    repo_type, owner_type = (docs.schema[c].dataType.simpleString() for c in (repo, owner))
    rows = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return tx.arrow_map(
        rows, _scan, f"repo {repo_type}, owner {owner_type}, print long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,ord:int,end:long,kind:string,hash:string,live:boolean>>"
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """For each candidate hash: distinct repositories and owners, and whether it is owner-specific."""
    seen = scanned.select("repo", "owner", F.explode("found").alias("c")).select(F.col("c.hash").alias("hash"), "owner", "repo", F.col("c.live").alias("live"))
    by_repo = seen.groupBy("hash", "owner", "repo").agg(F.max("live").alias("live"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("live").alias("live"))
    total = by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("live").alias("live"))
    return total.select("hash", "n_repos", "n_owners", (F.col("live") & (F.col("n_owners") <= MAX_OWNERS)).alias("owner_specific"))


def find(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and those that are owner-specific.

    ``spans`` is an array of (start, ord, end, kind, live); ``live`` says that
    the span's value is owner-specific and looks live.
    """
    scanned = stage(scan(docs, text, repo, owner), "secrets")
    own = ownership(scanned).where("owner_specific").select("hash")
    rows = scanned.where("size(found) > 0").select("repo", "print", F.explode("found").alias("c"))
    live = rows.where("c.live").select("repo", "print", "c", F.col("c.hash").alias("hash")).join(own, "hash", "left_semi")
    spans = live.groupBy("repo", "print").agg(F.collect_set(F.struct("c.start", "c.ord", "c.end", "c.kind")).alias("specific"))
    both = scanned.join(spans.withColumnsRenamed({"repo": "r", "print": "p"}), F.col("repo").eqNullSafe(F.col("r")) & (F.col("print") == F.col("p")), "left")
    base = F.filter("found", lambda c: c.ord < len(BASE))
    base = F.transform(base, lambda c: F.struct(c.start.alias("start"), c.ord.alias("ord"), c.end.alias("end"), c.kind.alias("kind")))
    specific = F.coalesce("specific", F.array().cast("array<struct<start:long,ord:int,end:long,kind:string>>"))
    return both.select(
        F.col("repo").alias("doc_id"), "print", "n_assign", "n_access", "n_hex", "base_sha256", F.array_sort(F.array_union(base, specific)).alias("all"), F.array_sort(specific).alias("specific")
    )


def spans_text(col) -> F.Column:
    return F.array_join(F.transform(col, lambda c: F.concat_ws(":", c.kind, c.start.cast("string"), c.end.cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every owner-specific span of ``text`` replaced by ``mark``; no row is dropped.

    Where a row has no such span it stays as it is, and all but a few of these
    rows are not shuffled (``sifted``). ``n_chars``, if there is one, follows the new
    text. Other columns may have any name that does not begin with ``__``.
    """
    apart = find(docs, text, repo, owner).where("size(specific) > 0").select(F.col("doc_id").alias("__repo"), F.col("print").alias("__print"), F.col("specific").alias("__specific"))
    apart = stage(apart.dropDuplicates(["__repo", "__print"]), "redactions")
    sifted = tx.sifted(docs.withColumn("__text_print", F.xxhash64(text)), "__text_print", apart, "__print")
    rows = sifted.where("__maybe")
    both = rows.join(apart, F.col(repo).eqNullSafe(F.col("__repo")) & (F.col("__text_print") == F.col("__print")), "left")
    # from the last span to the first, so that offsets stay right; spans that overlap are one
    merged = F.aggregate(F.array_sort("__specific"), F.array().cast("array<struct<start:long,end:long>>"), _merge)
    clean = F.aggregate(merged, F.col(text), lambda t, c: F.concat(F.substring(t, F.lit(1), c.start.cast("int")), F.lit(mark), F.substring(t, (c.end + 1).cast("int"), F.length(t))))
    out = both.withColumn(text, F.when(F.col("__specific").isNull(), F.col(text)).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__specific").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return sifted.where("NOT __maybe").select(*docs.columns).unionByName(out.select(*docs.columns))


def _merge(spans, c):
    """Adds a span, in order of start, to merged ones of which the last comes first."""
    last = F.get(spans, F.lit(0))
    own = F.struct(c.start.alias("start"), c.end.alias("end"))
    wider = F.struct(last.start.alias("start"), F.greatest(last.end, c.end).alias("end"))
    return F.when(F.coalesce(c.start < last.end, F.lit(False)), F.concat(F.array(wider), F.slice(spans, F.lit(2), F.size(spans)))).otherwise(F.concat(F.array(own), spans))
