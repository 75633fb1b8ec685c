"""What the training-data operators share: the folder all executors see, tables written to cut lineage, connected components, filters of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.tables import fresh_path, materialize, remove, shared_dir

__all__ = ["KeyFilter", "connected_components", "fresh_path", "materialize", "remove", "shared_dir"]

#: A filter of keys has this many bits for each key, a power of two in all, and at most so many.
KEY_BITS, MOST_BITS = 16, 1 << 26


class KeyFilter:
    """A test that holds for every value in keys (a written table), and for one in KEY_BITS of all others; never for null.

    It keeps rows that a join would drop out of the join's shuffle. Its bits, at
    most MOST_BITS, are gathered and sent to the tasks; with more keys than that
    more others pass, so the join has to follow where they matter. Tasks apply
    it inside a function that they run anyway: a worker more costs memory.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.bits = min(MOST_BITS, max(64, 1 << (KEY_BITS * keys.count()).bit_length()))
        found = keys.where(F.col(column).isNotNull()).select(self.place(column).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
        found = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(self.bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(words)

    def place(self, column: str) -> Column:
        return F.when(F.col(column).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(column), F.lit(self.bits)))

    def holds(self, places: pa.Array) -> np.ndarray:
        at = places.to_numpy()
        return (at >= 0) & ((self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    def rows(self, table: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows of table for whose column it holds, or the others."""
        names = table.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.holds(batch.column("_at")) == inside)).select(names)

        return table.withColumn("_at", self.place(column)).mapInArrow(run, table.schema)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Minimum labels travel over the edges and along the labels themselves
    (pointer jumping), so rounds grow with the logarithm of a path's length.
    Every step is a join or a partially aggregated minimum; no group of edges
    is ever gathered. Null ends and self-loops add no link.
    """
    both = materialize(
        edges.where("a is not null and b is not null and a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = labels.join(near, "node", "left").join(jump, "component", "left").select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("was"))
        step = materialize(step, "labels")
        moved = step.where("component <> was").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError("connected components did not settle")
