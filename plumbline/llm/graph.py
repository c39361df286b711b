"""Connected components by label propagation with pointer jumping, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label: the least node that can be reached.

    Each round hooks every node to its least neighbour, and to that one's least, then contracts
    the edges to what they join now: hubs with many edges shrink to a point in the first round, and
    the number of edges falls by half or more in each. Every round is written to the shared folder; only
    whether edges are left comes to the driver. Loops and repeated edges do no harm.
    """
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = left.select("a", "b").union(left.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("mid"))
        hooks = materialise(hooks, "hooks")
        hooks = materialise(hooks.join(hooks.select(F.col("node").alias("mid"), F.col("mid").alias("to")), "mid").select("node", "to"), "hooks")
        if labels is None:
            labels = hooks.withColumnRenamed("to", "label")
        else:
            labels = materialise(labels.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = left.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialise(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            return labels
