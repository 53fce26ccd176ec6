"""Connected components of an edge table by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (a hash aggregation, so a
    hub costs one row per task) and then the label of that label; labels only fall, and the
    loop ends when none did. Everything stays in tables.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = cut(lower)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = cut(lower.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        moved = stepped.filter("label < old").limit(1).count()
        labels = stepped.select("node", "label")
        if not moved:
            return labels
