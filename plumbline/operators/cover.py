"""Greedy selection for maximal coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import written

#: Steps after which what is left is written, so that no plan replays more than these.
STEPS = 4


def greedy_cover(tags: DataFrame, budget: int, tie: Callable[[Column], Column] = lambda item: item) -> DataFrame:
    """(rank, item, gain): in every step the item with most tags not covered yet; of equals the one with the least ``tie``, then the smallest.

    A step is one aggregation over the tags left, of which one row comes to the driver; covered tags
    leave by an anti join, so the data shrink. Stops when nothing is gained.
    """
    left = tags.select("item", "tag").where("item is not null and tag is not null").distinct()
    chosen: list[tuple] = []
    for rank in range(1, budget + 1):
        if rank % STEPS == 0:
            left = written(left, "cover")
        gains = left.groupBy("item").agg(F.count(F.lit(1)).alias("gain"))
        best = gains.agg(F.min(F.struct((-F.col("gain")).alias("loss"), tie(F.col("item")).alias("tie"), "item")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append((rank, best["item"], -best["loss"]))
        covered = left.where(F.col("item") == best["item"]).select("tag")
        left = left.join(covered, "tag", "left_anti").select("item", "tag")
    schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("item", tags.schema["item"].dataType), T.StructField("gain", T.LongType())])
    return tags.sparkSession.createDataFrame(chosen, schema)
