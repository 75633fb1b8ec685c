"""Groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.tables import materialize, remove


def linked_groups(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Each round takes the least label among a node's neighbours and the label of
    its own label, so rounds grow with the logarithm of a path's length. Steps
    are joins and partial minima, and every round is written, so that lost
    executors cost a read. Null ends and self-loops add nothing.
    """
    spark = edges.sparkSession
    ends = edges.where("a is not null and b is not null and a <> b")
    both = materialize(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "groups")
    for _ in range(max_rounds):
        least = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        beyond = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = labels.join(least, "node", "left").join(beyond, "component", "left").select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("was"))
        step = materialize(step, "groups")
        remove(spark, labels)
        labels = step.select("node", "component")
        if not step.where("component <> was").limit(1).count():
            remove(spark, both)
            return labels
    raise RuntimeError("groups did not settle")
