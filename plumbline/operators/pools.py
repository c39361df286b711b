"""Hierarchical means over frozen pools: item, then problem, then type.

A score is 1, 0 or null (the service gave no answer). Nulls are never skipped: a value is withheld
where any is missing and bounded by taking every null as 0 and as 1. Types are combined with fixed
weights that are not renormalised when a type is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problem_means(probes: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (by, probe_type, problem_id): probes m, sums with nulls as 0 and as 1, answered k."""
    v = F.col(score)
    return probes.groupBy(*by, "probe_type", "problem_id").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.coalesce(v, F.lit(0))).alias("s0"), F.sum(F.coalesce(v, F.lit(1))).alias("s1"), F.count(v).alias("k")
    )


def type_means(probes: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (by, probe_type): support, missing probes, bounds, value and coverage, each problem weighing the same."""
    share = lambda c: F.sum(F.col(c) / F.col("m")) / F.count(F.lit(1))
    out = problem_means(probes, score, by).groupBy(*by, "probe_type").agg(
        F.count(F.lit(1)).alias("n_problems"), F.sum("m").alias("n_probes"), F.sum(F.col("m") - F.col("k")).alias("n_missing"),
        share("s0").alias("lower_v"), share("s1").alias("upper_v"), share("k").alias("coverage"),
    )
    return out.withColumn("value", F.when(F.col("n_missing") == 0, F.col("lower_v")))


def combine(types: DataFrame, weights: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums over types; null where a weighted type has no support, whatever its weight."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("probe_type")]
    known = F.count(F.when(w.isNotNull(), 1))

    def total(column: str) -> Column:
        return F.when((known == len(weights)) & (F.count(F.when(w.isNotNull(), F.col(column))) == len(weights)), F.sum(w * F.col(column)))

    return types.groupBy(*by).agg(*(total(c).alias(c) for c in ("value", "lower_v", "upper_v", "coverage")))


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
