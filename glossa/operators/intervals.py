"""Interval operators: gaps, tiling, sortedness, overlap, and points to their owners.

Spans are half-open, ``start`` and ``end`` BIGINT columns; every operator
takes a ``key`` (a book, a page) within which spans belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.runtime import stage


def with_previous(rows: DataFrame, key: list[str], by: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``value`` of the row before within the key, null for its first; a key of any size is spread over tasks.

    Rows are range-partitioned by key and order; a partition's first row takes
    the value of the last row before, of which there is one for each partition.
    """
    order = {f"__k{i}": c for i, c in enumerate([*map(F.col, key), *by])}
    ranged = stage(rows.withColumns(order | {"__v": value}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "adjacent")
    edge = F.struct(*key, "__v")
    last = ranged.groupBy("__part").agg(F.max_by(edge, F.struct(*order)).alias("__last"))  # a row for each partition
    at = Window.orderBy("__part")
    before = last.select("__part", F.lag("__last").over(at).alias("__last"))
    inside = F.lag(edge).over(Window.partitionBy("__part").orderBy(*order))
    found = ranged.join(F.broadcast(before), "__part").withColumn("__e", F.coalesce(inside, F.col("__last")))
    same = F.lit(True)
    for k in key:
        same &= F.col("__e")[k].eqNullSafe(F.col(k))
    return found.withColumn(name, F.when(same, F.col("__e")["__v"])).drop("__part", "__last", "__e", "__v", *order)


def span_ok(start: Column, end: Column, bound: Column) -> Column:
    return (start >= 0) & (start <= end) & (end <= bound)


def gaps(spans: DataFrame, bounds: DataFrame, key: str, bound: str = "bound") -> DataFrame:
    """(key, start, end) of what the union of a key's spans leaves of [0, bound).

    Spans may nest and overlap. A key that has a bound and no span is one gap.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = spans.select(key, reach.alias("from"), F.col("start").alias("to"), "end")
    between = inner.where(F.col("from") < F.col("to")).select(key, F.col("from").alias("start"), F.col("to").alias("end"))
    last = bounds.select(key, bound).join(spans.groupBy(key).agg(F.max("end").alias("reach")), key, "left")
    tail = last.select(key, F.coalesce("reach", F.lit(0)).alias("start"), F.col(bound).alias("end")).where(F.col("start") < F.col("end"))
    return between.unionByName(tail)


def covered_length(spans: DataFrame, key: str) -> DataFrame:
    """(key, length) of the union of each key's spans."""
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(order), F.lit(0))
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))
    return spans.select(key, own.alias("own")).groupBy(key).agg(F.sum("own").alias("length"))


def tiling(ranges: DataFrame, key: list[str], offset: str = "offset", size: str = "size") -> DataFrame:
    """(key..., n_bad, total): how many distinct ranges do not begin where the one before ended, and where the last ends."""
    distinct = ranges.select(*key, offset, size).distinct()
    rows = with_previous(distinct, key, [F.col(offset), F.col(size)], F.col(offset) + F.col(size), "__before")
    bad = F.coalesce(F.col("__before"), F.lit(0)) != F.col(offset)
    return rows.withColumn("bad", bad).groupBy(*key).agg(F.sum(F.col("bad").cast("long")).alias("n_bad"), F.max(F.col(offset) + F.col(size)).alias("total"))


def unsorted(rows: DataFrame, key: list[str], position: str, by: list[Column]) -> DataFrame:
    """(key..., n_bad): adjacent pairs that are out of order."""
    item = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])
    bad = F.coalesce(F.col("__before") > item, F.lit(False))
    return with_previous(rows, key, [F.col(position)], item, "__before").withColumn("bad", bad).groupBy(*key).agg(F.sum(F.col("bad").cast("long")).alias("n_bad"))


def overlapping(spans: DataFrame, key: str) -> DataFrame:
    """Spans that begin before the one before them (by start, end) has ended."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return spans.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("start") < F.col("before"))


def _levels(spans: DataFrame) -> DataFrame:
    """Each span with the bin level whose width is the least power of 4 not below its length."""
    return spans.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double")))).cast("int"))


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(4.0), level)).cast("long")


def owners(points: DataFrame, spans: DataFrame, key: list[str], point: str = "pos", owner: str = "id") -> DataFrame:
    """Points with their owner: of the spans that hold the point, the shortest, and of those the least id.

    A stabbing join without an inequality join: a span lies in two bins at
    most of the level that fits its length, a point in one bin of each level
    in use, and both meet by equality. Points without an owner stay, with null.
    """
    levelled = _levels(spans.where("start < end"))
    bins = levelled.withColumn("bin", F.explode(F.array_distinct(F.array(_bin(F.col("start"), F.col("level")), _bin(F.col("end") - 1, F.col("level"))))))
    used = [r.level for r in levelled.select("level").distinct().collect()]  # 32 at most
    if not used:
        return points.withColumn("owner", F.lit(None).cast(spans.schema[owner].dataType))
    cuts = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), _bin(F.col(point), F.lit(x)).alias("bin")) for x in sorted(used)]))
    probes = points.select(*key, point).distinct().withColumn("c", cuts).select(*key, point, "c.level", "c.bin")
    hit = probes.join(bins, [*key, "level", "bin"]).where((F.col("start") <= F.col(point)) & (F.col(point) < F.col("end")))
    best = hit.groupBy(*key, point).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), F.col(owner).alias("o"))).alias("__best")).select(*key, point, F.col("__best.o").alias("owner"))
    return points.join(best, [*key, point], "left")


def numbered(rows: DataFrame, key: list[str], by: list[Column], name: str, first: int = 0) -> DataFrame:
    """Positions within each key, for keys whose rows fit a task (books, pages)."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*by)) - 1 + first).cast("long"))


def ordinals(rows: DataFrame, by: list[Column], name: str = "ordinal") -> DataFrame:
    """0-based positions in one global order, without a single-task window.

    Rows are range-partitioned and staged with their partition, so that the
    ranges are drawn once; partition counts (a row for each partition) give
    the offsets, and positions within a partition are a local window.
    """
    keys = {f"__k{i}": c for i, c in enumerate(by)}
    ranged = rows.withColumns(keys).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    ranged = stage(ranged, "ordered")
    counts = sorted(map(tuple, ranged.groupBy("__part").count().collect()))
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    base = rows.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(base), "__part").withColumn(name, (within + F.col("__before")).cast("long")).drop("__part", "__before", *keys)


def prefix_sum(rows: DataFrame, by: list[Column], value: str, name: str = "offset") -> DataFrame:
    """The sum of ``value`` over all rows before each in one global order, built like ``ordinals``."""
    keys = {f"__k{i}": c for i, c in enumerate(by)}
    ranged = stage(rows.withColumns(keys).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "summed")
    sums = sorted(map(tuple, ranged.groupBy("__part").agg(F.sum(value)).collect()))
    total, before = 0, []
    for part, n in sums:
        before.append((part, total))
        total += n or 0
    base = rows.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long")
    order = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(order), F.lit(0))
    return ranged.join(F.broadcast(base), "__part").withColumn(name, (within + F.col("__before")).cast("long")).drop("__part", "__before", *keys)
