"""HTML and CSS as tables: tokens, links, text, gates, scoped styles and replayed edits.

Whole-table columns run in codegen where a pattern says all there is to say;
the exact tokenizer runs as an Arrow kernel that gives one row for each token.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import css_kernel, html_kernel, layout_kernel
from glossa.functions.words import collapse_space
from glossa.operators.rejects import first_failure

TOKEN = "seq long, kind string, name string, closing boolean, start long, `end` long, attrs array<struct<name:string,start:long,end:long,value_start:long,value_end:long>>, code string"
_ATTRS = pa.list_(pa.struct([("name", pa.string()), *((n, pa.int64()) for n in ("start", "end", "value_start", "value_end"))]))
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), _ATTRS, pa.string())


def tokens(docs: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each token of each document; a document that breaks off ends with a row of kind ``error`` and its code."""

    def run(batches):
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data, n = (text or "") if isinstance(text, bytes) else (text or "").encode(), 0
                try:
                    for n, t in enumerate(html_kernel.tokens(data)):
                        rows.append((n, t.kind, t.name, t.closing, t.start, t.end, [a._asdict() for a in t.attrs], None))
                        owner.append(i)
                except html_kernel.HtmlError as e:
                    rows.append((n + 1, "error", str(e), False, None, None, [], e.code))
                    owner.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], [key, "seq", "kind", "name", "closing", "start", "end", "attrs", "code"])

    return docs.select(key, html).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {TOKEN}")


def plain_text(html: Column) -> Column:
    """Visible text by patterns: comments, style, script and tags removed, common references decoded."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return collapse_space(text)


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Visible text by the exact tokenizer; null for a document that it rejects."""

    def one(h):
        try:
            return html_kernel.plain_text(h.encode() if isinstance(h, str) else h)
        except html_kernel.HtmlError:
            return None

    return html.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchors(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_kernel.anchors(h.encode()), na_action="ignore")


def links(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, href) of the ``a`` elements, in order, outside comments, styles and scripts."""
    text = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    found = F.regexp_extract_all(text, F.lit(r"""<a\s(?:[^>]*?\s)?href="([^"]*)\""""), 1)
    return docs.select(key, F.posexplode(found).alias("seq", "href")).withColumn("seq", F.col("seq").cast("long"))


#: Elements that a dictionary's text may not hold.
FORBIDDEN = ("script", "iframe", "object", "embed", "form", "base")


def gate(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, code, message): the first construct of each document that the strict path refuses."""
    text = F.regexp_replace(F.lower(F.col(html)), r"(?s)<!--.*?-->", "")
    rules = [(text.contains(f"<{name}"), "UNSUPPORTED", f"element {name}") for name in FORBIDDEN]
    rules += [(text.rlike(r"<[^>]*\son[a-z]+\s*="), "UNSUPPORTED", "event handler"), (text.rlike(r"""(?:href|src)\s*=\s*["']?\s*javascript:"""), "UNSUPPORTED", "script address")]
    return docs.select(key, first_failure(rules).alias("f")).select(key, "f.code", "f.message")


@F.pandas_udf(T.StringType())
def scope_css(css: pd.Series, name: pd.Series) -> pd.Series:
    """Strictly scoped stylesheets; null for one that the strict grammar refuses."""

    def one(c, n):
        try:
            return None if c is None else css_kernel.scope(c, n)
        except css_kernel.CssError:
            return None

    return css.combine(name, one)


@F.pandas_udf(T.StringType())
def unsafe_css(css: pd.Series) -> pd.Series:
    return css.map(css_kernel.unsafe, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def replay(data: pd.Series, edits: pd.Series) -> pd.Series:
    """Bytes with their edits (start, end, replacement), sorted here, applied."""
    return data.combine(edits, lambda d, es: None if d is None else html_kernel.replay(bytes(d), sorted((e["start"], e["end"], bytes(e["replacement"])) for e in (es if es is not None else []))))


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_kernel.sanitize(h.encode()).decode(), na_action="ignore")


def link_plan(tags: DataFrame, anchors_: DataFrame, routes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(plan, missing): links (key, seq, anchor) with the route of what owns the anchor, and those without an anchor.

    ``anchors_`` (key, anchor, entry_id, page_id) and ``routes`` (kind, id,
    route): an anchor in an entry leads to the entry, another to its page.
    """
    entry, page = routes.where("kind = 'entry'"), routes.where("kind = 'page'")
    found = tags.join(anchors_, [key, "anchor"], "left")
    missing = found.where("page_id IS NULL").select(key, "seq", "anchor")
    named = found.where("page_id IS NOT NULL").join(entry.select(F.col("id").alias("entry_id"), F.col("route").alias("er")), "entry_id", "left").join(page.select(F.col("id").alias("page_id"), F.col("route").alias("pr")), "page_id", "left")
    return named.select(key, "seq", F.coalesce("er", "pr").alias("route"), "anchor"), missing


def first_positions(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values in order of first appearance within a key, repeats dropped."""
    w = Window.partitionBy(key, value).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


LAYOUT = T.StructType([T.StructField("html", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType())), T.StructField("code", T.StringType())])


@F.pandas_udf(LAYOUT)
def readable(html: pd.Series) -> pd.DataFrame:
    """(html, counts, code): articles in the readable layout; one that cannot be parsed stays as it is, with a code."""
    rows = []
    for h in html:
        try:
            edits, counts = layout_kernel.edits((h or "").encode())
            rows.append((html_kernel.replay((h or "").encode(), edits).decode(), dict(counts), None))
        except html_kernel.HtmlError as e:
            rows.append((h, {}, e.code))
    return pd.DataFrame(rows, columns=["html", "counts", "code"])
