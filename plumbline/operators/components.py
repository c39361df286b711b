"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "components") -> DataFrame:
    """``df`` written to the shared folder and read again; this survives lost executors."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component: the least node within reach.

    Each round hooks every node to its least neighbour and replaces edges by what they join then, so
    at least half of the nodes of every component go in a round.
    """
    left, found = written(edges.select("a", "b").where("a <> b").distinct()), None
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")))
        hooks = written(hooks.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        if found is None:
            found = hooks.withColumnRenamed("to", "component")
        else:
            found = found.join(hooks.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = written(found)
        a, b = (hooks.select(F.col("node").alias(n), F.col("to").alias(f"{n}2")) for n in "ab")
        left = written(left.join(a, "a").join(b, "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
    if found is None:
        return alone
    return found.union(alone.join(found, "node", "left_anti"))
