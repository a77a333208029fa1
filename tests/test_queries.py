"""Every registered lexicon query against its SQL on the smallest tables."""

import math

import pytest

from glossa.plans.catalogue import ORACLES, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else v if isinstance(v, str | bool) else round(float(v), 6) if not float(v).is_integer() or math.isinf(v) else int(v)
    return sorted(repr(tuple(map(clean, r))) for r in frame.itertuples(index=False, name=None))


def pages(spark, tmp_path, html):
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_all_links_are_resolved(spark, tmp_path):
    refs = ["http://x/y", "#top", "q.html#a%20b", "a?b", "/root", "../../up", "a%zz", ""]
    got = QUERIES["resolve_all_links"](spark, pages(spark, tmp_path, ["".join(f'<a href="{r}">' for r in refs)])).orderBy("seq").collect()
    assert [(r.kind, r.file, r.anchor) for r in got] == [
        ("external", None, None), ("internal", "book/page.xhtml", "top"), ("internal", "book/q.html", "a b"), ("error", None, None),
        ("error", None, None), ("error", None, None), ("error", None, None), ("internal", "book/page.xhtml", None),
    ]


def test_long_chapter_titles_are_cut(spark, tmp_path):
    got = QUERIES["chapter_keys"](spark, pages(spark, tmp_path, [f"<title>{t}</title>" for t in ("short", "é" * 300, "x" * 199)])).collect()
    assert {r.page_id: r.key_bytes for r in got} == {0: 22, 1: 249, 2: 216}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) or name == "path_collisions"
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
