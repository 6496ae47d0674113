"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of `edges` (long a, long b); component is the smallest node of it.

    Each round every node steps to its smallest neighbour or stays, and the edges follow, until none
    is left. Nodes with a neighbour at least halve, so rounds grow with the logarithm of the nodes.
    Only staged tables carry over; the driver sees nothing but whether edges are left. A node with very
    many neighbours sends one minimum per task, and joins on it are salted.
    """
    left = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        step = stage(step.select("node", F.least("node", "to").alias("to")), "edge-steps")
        steps.append(step)
        moved = join_unique(left, step.withColumnsRenamed({"node": "a", "to": "x"}), "a", hot_rows=hot_rows, stable_left=True)
        moved = stage(moved.select("b", "x"), "edges-half")
        moved = join_unique(moved, step.withColumnsRenamed({"node": "b", "to": "y"}), "b", hot_rows=hot_rows, stable_left=True)
        left = stage(moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].withColumnRenamed("to", "component")
    for step in steps[1:]:
        nexts = step.withColumnsRenamed({"node": "component", "to": "next"})
        labels = join_unique(labels, nexts, "component", "left", hot_rows=hot_rows, stable_left=True)
        labels = stage(labels.select("node", F.coalesce("next", "component").alias("component")), "edge-labels")
    # a contracted node is named by one of its members, not always the smallest
    lowest = stage(labels.groupBy("component").agg(F.min("node").alias("lowest")), "edge-lowest")
    named = join_unique(labels, lowest, "component", hot_rows=hot_rows, stable_left=True)
    return named.select("node", F.col("lowest").alias("component"))
