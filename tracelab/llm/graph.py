"""Connected components by label propagation with pointer jumping, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every id that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; rows with a null and loops count for nothing, direction and
    repeats do not matter. Returns ``id, component``. Each round joins every label with the labels of
    its neighbours (grouped minimum, combined before the shuffle, so a hub is no hot task) and then
    follows the label's own label, which halves the longest path. Ends when no label changes.
    """
    both = (
        edges.where("a != b")
        .select("a", "b")
        .unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct()
    )
    both = staged(both, "cc-edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "id"), "cc-0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("id").alias("b"), "l"), "b")
            .groupBy("a")
            .agg(F.min("l").alias("m"))
            .withColumnRenamed("a", "id")
        )
        moved = labels.join(near, "id").select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = labels.select(F.col("id").alias("l"), F.col("l").alias("upper"))
        moved = moved.join(up, "l").select("id", "old", F.least("l", "upper").alias("l"))
        moved = staged(moved, f"cc-{turn}")
        if moved.where("l != old").isEmpty():
            return moved.select("id", F.col("l").alias("component"))
        labels = moved.select("id", "l")
