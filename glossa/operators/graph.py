"""Connected components over an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.runtime import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its smallest node.

    Each round takes the least label among a node's neighbours and then the
    label of its label, so chains shorten by half at least. Labels are staged
    between rounds; only their count of changes reaches the driver. Null ends
    and loops are ignored; an empty table gives no rows.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL AND node <> other")
    both = stage(pairs.union(pairs.select("other", "node")).distinct(), "edges")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        # the label's own label: rows that follow a hot label are split by adaptive execution
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = low.join(labels.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left")
        new = stage(up.select("node", "was", F.least("label", "above").alias("label")), "labels")
        unstage(labels)
        if not new.where("label <> was").limit(1).count():
            unstage(both)
            return new.select("node", F.col("label").alias("component"))
        labels = new
