"""Connected components by repeated joins; labels and links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): component is the smallest node reachable.

    Each round takes the least label among neighbours and then follows the label once (pointer jumping); it stops
    when no label changes. Each round's labels are a written table, so a lost executor costs one round at most.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = written(hooked.join(target, "label", "left").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        if after.filter("old <> label").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
