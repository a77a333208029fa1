"""Repeated ids, clashing names, null ids and hot rows in the stages and their operators."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.llm import langid, mixing, neardup, secrets
from glossa.llm import text as tx
from glossa.runtime import stage, unstage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("turns", "nth", "specific", "score", "lang_pred", "print", "sid", "start", "size", "repo", "owner", "rep", "key", "kept", "component", "node", "key0")


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that occur twice in two sources, of the same word counts, repeated rows and null ids."""
    rows = []
    for i in range(30):
        for source in ("a", "b"):
            rows.append((i, " ".join(f"{source}{i}w{k}" for k in range(300)), "en", source, None))
    rows += [(100 + i, " ".join(f"c{i}w{k}" for k in range(300)), "en", "c", None) for i in range(20)]
    rows += [(7, rows[14][1], "en", "a", None)] * 2 + [(None, "one two three", None, None, None)] * 2 + [(500, None, None, "a", None), (501, " ", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_samples_take_the_words_of_the_summary_where_ids_repeat(repeated):
    sizes = repeated.select("doc_id", "source", "text").collect()
    total = Counter()
    for r in sizes:
        total[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))]), strict=True))
    got, words = Counter(), Counter()
    out = mixing.sample(with_clashes(repeated)).collect()
    for r in out:
        got[r.source] += len(WORD.findall(r.text or ""))
        for w in WORD.findall(r.text or ""):
            words[w] += 1
        assert all(r[c] == f"own {c}" for c in CLASHING)
    assert all(abs(got[s] - goal[s]) <= 1 for s in names)
    have = Counter(w for r in sizes for w in WORD.findall(r.text or ""))
    assert all(n <= 3 * have[w] for w, n in words.items())
    # a row holds words of its own source only
    assert all(w[0] == r.source for r in out if r.source in ("a", "b", "c") for w in WORD.findall(r.text or ""))
    assert sum(not (r.text or "").strip() for r in out) == 2


def test_redaction_with_clashing_names_and_repeated_rows(spark):
    live = "k3Jd92LmQp81ZxTyR4wV6uNs0"
    rows = [(1, f"key {live} end", "a"), (1, f"key {live} end", "a"), (None, f"{live}{live}", "a"), (2, "no secret", "b"), (3, None, "b"), (4, f"ä password={live} 中 token: {live}", "a"), (5, "", None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter({(1, "key [SECRET] end"): 2, (None, "[SECRET]"): 1, (2, "no secret"): 1, (3, None): 1, (4, "ä [SECRET] 中 [SECRET]"): 1, (5, ""): 1})


def test_sieves_lose_no_key(spark):
    keys = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS k")
    rows = tx.sifted(spark.range(3000).selectExpr("id", "concat('k', id) AS word"), "word", keys, "k")
    maybe = {r.id for r in rows.where("__maybe").collect()}
    assert set(range(0, 3000, 7)) <= maybe and len(maybe) < 500 and rows.count() == 3000
    assert tx.sifted(rows.drop("__maybe"), "word", keys.where("false"), "k").where("__maybe").count() == 0


def test_one_row_of_a_repeated_id_is_kept(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand here now too"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (3, "")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({1: 1, 3: 1, None: 2})


def test_an_id_with_a_copy_of_another_keeps_one_row(spark):
    """Of id 5, a row that copies id 1 and one that does not; the only row without an id, which copies id 1, too."""
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "other words stand here now too"), (None, "a b c d e f")]
    out = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, 5: 1, None: 1})


def test_rows_alike_in_all_but_further_columns_are_mixed_each(spark):
    """Rows of one id, source and text keep their own further columns, and another id's words stay its own."""
    rows = [(i % 3 if i < 30 else i, "one two three four five" if i < 30 else f"w{i} " * 40, "a", f"row {i}") for i in range(60)]
    rows += [(None, "null id here", None, "row 60"), (None, "null id here", None, "row 61")]
    out = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(3)).collect()
    of = {r[3]: r for r in rows}
    have = Counter()
    for r in out:
        assert (r.doc_id, r.source) == (of[r.note][0], of[r.note][2]) and set(r.text.split()) <= set(of[r.note][1].split())
        have[r.note] += len(r.text.split())
    assert all(have[n] <= 3 * len(of[n][1].split()) for n in have)
    assert sum(have.values()) == sum(len(r[1].split()) for r in rows)


def shuffled(spark) -> int:
    """Bytes of shuffle files written so far by this session's executors."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture(scope="module")
def long_texts(spark):
    """600 texts of 10 KB that are unlike one another, near copies of 5, and the bytes that one shuffle of all writes."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(1000)), "abc"[i % 3]) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " tail", "a") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    docs, before = stage(df, "long-texts"), shuffled(spark)
    docs.repartition(4, "doc_id").write.format("noop").mode("overwrite").save()
    yield docs, shuffled(spark) - before
    unstage(docs)


def test_dedup_shuffles_the_texts_of_few_documents(spark, long_texts):
    docs, once = long_texts
    before = shuffled(spark)
    assert neardup.deduplicate(docs).select(F.sum(F.length("text")), F.count(F.lit(1))).collect()[0][1] == 600
    assert shuffled(spark) - before < 0.5 * once


def test_mixing_shuffles_texts_once(spark, long_texts):
    docs, once = long_texts
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many documents
    try:
        assert mixing.sample(docs).select(F.sum(F.length("text"))).collect()[0][0] > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 1.5 * once


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def count():
        files = disk.getAllFiles()
        return sum("shuffle" in files.apply(i).getName() for i in range(files.size()))

    before = count()
    out = stage(spark.range(100_000).groupBy((F.col("id") % 9973).alias("k")).count(), "cleaned")
    for _ in range(50):  # files are removed in the background
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before and out.count() == 9973
    unstage(out)


def test_languages_with_clashing_names_many_labels_and_ties(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en") for i in range(20)] + [(100 + i, "der hund und die katze sind nicht hier " * 3, "de") for i in range(20)] + [(200 + i, "xyzzy plugh", f"l{i}") for i in range(100)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(df)
    assert len(model["langs"]) == langid.LANGUAGES and {"en", "de"} <= set(model["langs"])
    out = langid.identify(df, model, keep=tuple(df.columns), names=("__lang", "__score"))
    assert all(r["__lang"] == r.lang for r in out.where("lang IN ('en', 'de')").collect())
    assert langid.identify(df, langid.fit(df.where("lang = 'en'"))).select("lang_pred").distinct().collect()[0][0] == "en"


def test_pipeline_stages_with_clashing_names(spark, repeated, tmp_path):
    import corpus_pipeline

    docs = with_clashes(repeated)
    for _, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, "")
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
