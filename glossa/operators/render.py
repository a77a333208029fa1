"""Edit plans: what is changed in a book's text so that its links, images and styles work in the dictionary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glossa.functions import html_kernel, words
from glossa.operators.intervals import overlapping, owners
from glossa.operators.markup import tokens
from glossa.operators.rejects import failures, missing, together

ANCHOR = "glo-pos-"


#: Bytes of payloads in a batch that a book's kernel gives.
BATCH_BYTES = 4 << 20


def attributes(texts: DataFrame) -> DataFrame:
    """(book_id, seq, tag, name, attr_start, value_start, value_end, value) of all tags' attributes that have a value.

    Read in one pass over each text; a text that breaks off gives those before.
    """
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                data, rows = data.as_py() or b"", []
                data = data.encode() if isinstance(data, str) else data
                try:
                    for seq, t in enumerate(html_kernel.tokens(data)):
                        if t.kind == "tag" and not t.closing:
                            rows += [(seq, t.name, a.name, a.start, a.value_start, a.value_end, data[a.value_start : a.value_end].decode(errors="replace")) for a in t.attrs if a.value_start >= 0]
                except html_kernel.HtmlError:
                    pass
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                owner = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["book_id", "seq", "tag", "name", "attr_start", "value_start", "value_end", "value"])

    return texts.select("book_id", "text").mapInArrow(run, f"book_id {texts.schema['book_id'].dataType.simpleString()}, seq long, tag string, name string, attr_start long, value_start long, value_end long, value string")


def cut(spans: DataFrame, content: DataFrame) -> DataFrame:
    """(book_id, id, payload): the bytes of each span (book_id, id, start, end) of its book's text.

    With a column ``es`` of edits (start, end, replacement) these are replayed.
    A book's text meets all of its spans in one row, so it is moved once and
    not once for each of them.
    """
    edited = "es" in spans.columns
    wanted = spans.groupBy("book_id").agg(F.collect_list(F.struct("id", "start", "end", *["es"] * edited)).alias("spans"))
    kind = spans.schema["id"].dataType

    def one(text: bytes, s: dict) -> bytes:
        if not edited or not s["es"]:
            return text[s["start"] : s["end"]]
        return html_kernel.replay(text, sorted((e["start"], e["end"], e["replacement"].encode()) for e in s["es"]), s["start"], s["end"])

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                book, text, ids, out, size = batch.column(0).slice(k, 1), batch.column(2)[k].as_py() or b"", [], [], 0
                for s in [*batch.column(1)[k].as_py(), None]:
                    if s is None or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([book.take(pa.array([0] * len(ids), pa.int64())), pa.array(ids, to_arrow_type(kind)), pa.array(out, pa.binary())], ["book_id", "id", "payload"])
                        ids, out, size = [], [], 0
                    if s is not None:
                        ids.append(s["id"])
                        out.append(one(text, s))
                        size += len(out[-1])

    both = wanted.join(content.select("book_id", F.col("text").cast("binary").alias("text")), "book_id").select("book_id", "spans", "text")
    return both.mapInArrow(run, f"book_id {spans.schema['book_id'].dataType.simpleString()}, id {kind.simpleString()}, payload binary")


def plan(texts: DataFrame, entries: DataFrame, resources: DataFrame, namespaces: DataFrame, sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edits, failures) of compiled books.

    Links to byte positions (``filepos``) or anchors become lookups of the
    owning entry with an anchor at the position; images by number become
    paths, with ``sources`` in an attribute ``src``. ``entries`` (book_id, id, start, end), ``resources`` (book_id,
    recindex, file), ``namespaces`` (book_id, namespace). Edits are
    (book_id, start, end, replacement, reason).
    """
    found = attributes(texts)
    marks = found.where("name = 'id' OR (tag = 'a' AND name = 'name')").select("book_id", F.col("value").alias("anchor"), "seq")
    places = tokens(texts.select("book_id", "text"), "book_id", "text").select("book_id", "seq", "start")
    anchored = marks.join(places, ["book_id", "seq"]).groupBy("book_id", "anchor").agg(F.min("start").alias("target"), F.count_distinct("start").alias("n"))
    hrefs = found.where("tag = 'a' AND ((name = 'href' AND value LIKE '#%') OR name = 'filepos')").withColumn("anchor", F.when(F.col("name") == "href", F.expr("substring(value, 2)")))
    linked = hrefs.join(anchored, ["book_id", "anchor"], "left").withColumn("pos", F.coalesce("target", F.when(F.col("name") == "filepos", F.expr("try_cast(value AS bigint)"))))
    owned = owners(linked.where("pos IS NOT NULL").select("book_id", "pos").distinct(), entries.select("book_id", "id", "start", "end"), ["book_id"]).join(namespaces, "book_id")
    route = F.concat(F.lit("bword://"), words.routing_key(F.col("namespace"), F.col("owner")), F.lit(f"#{ANCHOR}"), F.col("pos").cast("string"))
    edit = lambda start, end, new, reason: [start.alias("start"), end.alias("end"), new.alias("replacement"), F.lit(reason).alias("reason")]
    links = linked.join(owned.where("owner IS NOT NULL"), ["book_id", "pos"]).select("book_id", *edit(F.col("value_start"), F.col("value_end"), route, "link"))
    targets = owned.where("owner IS NOT NULL").select("book_id", *edit(F.col("pos"), F.col("pos"), F.concat(F.lit(f'<a id="{ANCHOR}'), F.col("pos").cast("string"), F.lit('"></a>')), "anchor"))
    numbers = found.where("tag = 'img' AND name = 'recindex'").withColumn("recindex", F.expr("try_cast(value AS bigint)"))
    images = numbers.join(resources.select("book_id", "recindex", "file"), ["book_id", "recindex"]).select("book_id", *edit(F.col("value_start"), F.col("value_end"), F.col("file"), "image"))
    renamed = numbers.where("recindex IS NOT NULL").select("book_id", *edit(F.col("attr_start"), F.col("attr_start") + len("recindex"), F.lit("src"), "source"))
    edits = links.unionByName(targets).unionByName(images)
    edits = edits.unionByName(renamed) if sources else edits
    bad = together(
        failures(linked, "link", F.col("value"), F.col("pos").isNull(), "INCOMPLETE", "no target"),
        failures(anchored, "anchor", F.col("anchor"), F.col("n") > 1, "MALFORMED", "anchor at several positions"),
        failures(owned, "owner", F.col("pos"), F.col("owner").isNull(), "INCOMPLETE", "target outside every entry"),
        missing(numbers, resources.select("book_id", "recindex"), ["book_id", "recindex"], "image", "value"),
        failures(overlapping(edits.select("book_id", "start", "end"), "book_id"), "edit", F.col("start"), F.lit(True), "MALFORMED", "edits overlap"),
    )
    return edits, bad


def definitions(spans: DataFrame, content: DataFrame, edits: DataFrame, prefix: DataFrame) -> DataFrame:
    """(book_id, id, payload): the prefix, the bytes of each span with its edits replayed, and the closing tags of the prefix's wrapper.

    ``spans`` (book_id, id, start, end), ``content`` (book_id, text),
    ``edits`` (book_id, start, end, replacement), ``prefix`` (book_id,
    prefix, suffix). Edits are grouped by the span that holds them.
    """
    points = edits.select("book_id", F.col("start").alias("pos"), F.struct("start", "end", "replacement").alias("e"))
    held = owners(points.select("book_id", "pos").distinct(), spans, ["book_id"]).join(points, ["book_id", "pos"]).groupBy("book_id", F.col("owner").alias("id")).agg(F.collect_list("e").alias("es"))
    empty = F.array().cast("array<struct<start:long,end:long,replacement:string>>")
    rows = spans.select("book_id", "id", "start", "end").join(held, ["book_id", "id"], "left").withColumn("es", F.coalesce("es", empty))
    body = cut(rows, content).join(prefix, "book_id", "left")
    whole = F.concat(F.encode(F.coalesce("prefix", F.lit("")), "utf-8"), F.col("payload"), F.encode(F.coalesce("suffix", F.lit("")), "utf-8"))
    return body.select("book_id", "id", whole.alias("payload"))


def keys(entries: DataFrame, edits: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(book_id, word, target_id): the generated key of each entry, and the keys that links use, with their anchors."""
    own = entries.select("book_id", "id").join(namespaces, "book_id").select("book_id", words.routing_key(F.col("namespace"), F.col("id")).alias("word"), F.col("id").alias("target_id"))
    used = edits.where("reason = 'link'").select("book_id", F.regexp_extract("replacement", "^bword://(.*)$", 1).alias("word")).distinct()
    entry = F.conv(F.regexp_extract("word", "_entry_([0-9a-f]{16})#", 1), 16, 10).cast("long")
    return own.unionByName(used.select("book_id", "word", entry.alias("target_id")))
