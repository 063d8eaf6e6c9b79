"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of edges: root is the smallest node that it is linked with, over any number of steps.

    Each round lets every node point to its smallest neighbour, follows the pointers once, and
    replaces edges by edges between what their ends point to; edges within one node vanish. Chains
    shrink geometrically, so rounds are few. Rows stay as many as nodes and edges; each round is
    written to the shared folder, which ends its lineage.
    """
    left = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while left.head(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        points = written(points, "pointers")
        # A node points to a smaller one or to itself, so pointers have no cycles.
        step = written(points.join(points.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")), "steps")
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            again = labels.join(step.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left")
            labels = written(again.select("node", F.coalesce("next", "root").alias("root")), "labels")
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
