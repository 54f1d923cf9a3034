"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node that links reach.

    Each round takes the least label of all neighbours and then that label's own label, so chains halve;
    only the number of changed labels comes to the driver.  A node with very many links is no burden:
    minima are taken before the shuffle, and sorted joins on it can be split.
    """
    ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))
    # Every node is a neighbour of itself, so that one sum by node has its own label too.
    both = cut(edges.filter("a <> b").select(F.inline(ends)).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
        hop = near.agg(F.min("label").alias("label"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        step = hop.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = cut(step.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.filter("label <> old").count()
        labels = new.select("node", "label")
        del near, hop, step, new
        release(edges.sparkSession)
        if not changed:
            return labels
