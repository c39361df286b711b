"""Whitening of embeddings by MLlib's RowMatrix over exactly centred rows.

Vectors become whole numbers, so their sums are exact at any size. A row is centred as the integer n * x - S
and divided by n once; ``computeGramianMatrix`` of these rows, divided by n, is the covariance. Its eigenvectors are found
on the driver, from a matrix as large as the dimensions squared; the whitening matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The grid of entries and its origin; components that are given.
SCALE, ORIGIN, COMPONENTS = 1024, 100_000, 8
LONG = 2**63


def grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the vectors that can be used.

    Out go null and empty vectors, those with null or non-finite entries (or one so large that x is no long), and
    those whose length isn't the commonest (the longer one of two).
    """
    c, edge = F.col("c"), float(2**62) / SCALE  # NaN is larger than any number
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    rows = rows.where((F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v) < edge, F.lit(False))))
    longest = rows.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    # A filter may be evaluated after the projection, so that sees no entry that overflows either.
    whole = F.transform(c, lambda v: F.floor(F.when(F.abs(v) < edge, v) * SCALE) + ORIGIN)
    return rows.where(F.size(c) == (longest["size"] if longest else 0)).select("vec_id", whole.alias("x"))


def sums(points: DataFrame) -> tuple[int, list[int], int]:
    """How many vectors there are, the exact sum of each dimension, and the largest distance from an entry to the whole part of its mean."""
    high = F.shiftright("v", 31)
    totals = points.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(high).alias("high"), F.sum(F.col("v") - F.shiftleft(high, 31)).alias("low"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    rows = totals.orderBy("dim").collect()  # one row per dimension
    if not rows:
        return 0, [], 0
    n, total = rows[0]["n"], [(r["high"] << 31) + r["low"] for r in rows]
    return n, total, max(max(r["most"] - s // n, s // n - r["least"]) for r, s in zip(rows, total, strict=True))


def covariance(points: DataFrame, n: int, total: list[int], reach: int) -> np.ndarray:
    """Covariance of the vectors, divisor n: Gramian of centred rows. No row leaves its executor."""
    kind = "long" if (reach + 1) * n < LONG else "decimal(38,0)"
    mean = F.array(*(F.lit(s // n) for s in total))
    rest = F.array(*(F.lit(s % n) for s in total))
    exact = F.zip_with(F.zip_with("x", mean, lambda x, m: (x - m).cast(kind)), rest, lambda d, r: d * F.lit(n) - r)
    rows = points.select(array_to_vector(F.transform(exact, lambda d: d.cast("double") / F.lit(float(n)))).alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row")).computeGramianMatrix().toArray()
    return (gram + gram.T) / (2.0 * n)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns, whose entry of largest magnitude is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1][:most], 0.0), vectors[:, ::-1][:, :most]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def _whitener(shared, n: int, total: list[int], reach: int):
    """Batches of vec_id, no_id and x to vec_id, no_id, deviation and the whitened coordinates."""
    whole, rest = [s // n for s in total], [s % n for s in total]
    fits = (reach + 1) * n < LONG and ((reach + 1) * n) ** 2 * len(total) < LONG

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, part, matrix = np.array(whole, np.int64), np.array([r / n for r in rest]), shared.value
        for batch in batches:
            if not len(batch):
                continue
            d = np.stack(batch["x"].to_numpy()) - mean
            if fits:
                deviation = ((d * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
            else:
                exact = (sum((int(v) * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in d)
                deviation = [v if v < LONG else None for v in exact]
            # einsum and not a matrix product: the same row gives the same bits in any batch
            coordinates = np.einsum("ij,jk->ik", d - part, matrix)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "no_id": batch["no_id"], "deviation": pd.array(deviation, "Int64"), "w": list(coordinates)})

    return run


def whiten(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector and component.

    Usable: see ``grid``. All usable vectors are fitted, repeated ones and those with a null id too. With fewer dimensions than ``most`` there are as many
    components. A component without variance (an eigenvalue below what double precision can tell from 0, as when there is
    one vector, or all are alike) has whitened 0, and explained 0 if there is no variance at all; it doesn't count in identity_error, which
    is 0 if no other is left. A deviation beyond a long is null. Without usable vectors there are no rows.
    """
    spark = vectors.sparkSession
    points = grid(vectors, id_col, vector_col)
    n, total, reach = sums(points)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    cov = covariance(points, n, total, reach)
    values, axes = components(cov, most)
    live = [bool(v > len(cov) * np.finfo(float).eps * values[0]) for v in values]
    scale = np.array([v**-0.5 if ok else 0.0 for v, ok in zip(values, live, strict=True)])
    trace = float(np.trace(cov))
    # Pandas would make floats of ids if there were nulls among them.
    told = points.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "x")
    rows = told.mapInPandas(_whitener(spark.sparkContext.broadcast(axes * scale), n, total, reach), "vec_id long, no_id boolean, deviation long, w array<double>")
    rows = materialise(rows.withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id"))), "whitened")
    error = identity_error(rows, [k for k, ok in enumerate(live) if ok])
    explained = F.array(*(F.lit(float(v / trace) if trace > 0 else 0.0) for v in values))
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )


def identity_error(rows: DataFrame, live: list[int]) -> float:
    """Largest absolute entry of the covariance of ``w`` (centred, divisor n) minus the identity, over the given coordinates."""
    if not live:
        return 0.0
    w = [F.col("w")[k] for k in live]
    means = rows.agg(*(F.avg(c) for c in w)).first()
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    found = rows.agg(*(F.avg((w[i] - means[i]) * (w[j] - means[j])) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
