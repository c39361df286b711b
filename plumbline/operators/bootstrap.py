"""Paired cluster bootstrap: clusters are drawn with replacement, and every statistic sees the same draws.

Data shrink to one row of numbers per cluster before any draw, and no draw is ever a row: a task draws a few replicates
in arrays, once, and counts how often each cluster came; the counts meet the values block by block. Sums over clusters
add up over blocks; statistics are expressions over these sums. Statistics that need the counts themselves are functions
that run in the tasks, which then hold all clusters.

Draws are hash-indexed (reproducible in any engine) or those of Python's generator, which ``random.Random(seed).choice``
makes over sorted clusters, replicate by replicate. A replicate without a value withholds the interval.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import written

#: Clusters of a block, replicates of a slice, and replicates that one task draws where there are several blocks.
BLOCK, SLICE, DRAWN = 1 << 17, 125, 25


def cluster_moments(probes: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(cluster_id, probe_type): number of problems and sums of problem means of every score."""
    means = probes.groupBy("cluster_id", "probe_type", "problem_id").agg(*(F.avg(c).alias(n) for n, c in scores.items()))
    return means.groupBy("cluster_id", "probe_type").agg(F.count(F.lit(1)).alias("k"), *(F.sum(n).alias(n) for n in scores))


def numbered(clusters: DataFrame) -> DataFrame:
    """The distinct rows of ``clusters`` by cluster_id and ix, their positions from 0 in the order of ids.

    Ranges of ids are sorted side by side and written once, so that positions never depend on a second
    evaluation; only one count per range meets in a window.
    """
    at = F.monotonically_increasing_id()
    ranged = written(clusters.select("cluster_id").distinct().repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").withColumn("at", at), "clusters")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    shift = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))  # a row per range
    return ranged.join(F.broadcast(shift), "part").select("cluster_id", (F.col("at") + F.col("shift")).alias("ix"))


def hash_draws(seed: int, n: int, first: int, last: int) -> Iterator[np.ndarray]:
    """Positions drawn for replicates ``first`` to ``last`` - 1: eight of four bytes each from SHA-256 of seed, replicate and eighth of the slot."""
    for r in range(first, last):
        digests = b"".join(hashlib.sha256(f"{seed}:{r}:{k}".encode()).digest() for k in range((n + 7) // 8))
        yield np.frombuffer(digests, ">u4")[:n].astype(np.int64) % n


def python_draws(seed: int, n: int, first: int, last: int) -> Iterator[np.ndarray]:
    """The positions that ``random.Random(seed).choice`` takes from ``n`` items, replicate by replicate.

    The generator has no way to skip, so a slice passes over what comes before it, in arrays.
    """
    version, state, _ = random.Random(seed).getstate()
    words = np.random.RandomState()
    words.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    bits, left, done = 32 - n.bit_length(), np.zeros(0, np.int64), 0
    while done < last:
        drawn = words.randint(0, 1 << 32, size=max(2 * n, 1 << 12), dtype=np.uint32) >> np.uint32(bits)
        left = np.concatenate([left, drawn[drawn < n].astype(np.int64)])
        whole = len(left) // n
        for k in range(whole):
            if first <= done + k < last:
                yield left[k * n : (k + 1) * n]
        left, done = left[whole * n :], done + whole


DRAWS = {"hash": hash_draws, "python": python_draws}


def _blocks(moments: DataFrame, replicates: int) -> tuple[DataFrame, int]:
    """Blocks of clusters (low: first position, width, values: rows in the order of positions), one copy for each slice of replicates (first, last), and how many clusters there are."""
    order = written(numbered(moments), "cluster-order")
    n = order.count()
    rows = moments.join(order, "cluster_id").groupBy(F.floor(F.col("ix") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("ix", "values"))).alias("rows"))
    packed = written(rows.select((F.col("block") * BLOCK).alias("low"), F.flatten(F.transform("rows", lambda x: x["values"])).alias("values"), F.size("rows").alias("width")), "cluster-blocks")
    slices = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(SLICE))))
    return slices.withColumn("last", F.least(F.col("first") + SLICE, F.lit(replicates))).repartition("low", "first"), n


def _each_slice(batches: Iterator[pa.RecordBatch], draws: str, seed: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Replicate, counts in the block and the block's values (a row per cluster)."""
    for batch in batches:
        for row in range(batch.num_rows):
            low, width, first, last = (batch.column(c)[row].as_py() for c in ("low", "width", "first", "last"))
            values = batch.column("values")[row].values.to_numpy(zero_copy_only=False).reshape(width, -1)
            for k, at in enumerate(DRAWS[draws](seed, n, first, last)):
                inside = at if width == n else at[(at >= low) & (at < low + width)]
                yield first + k, np.bincount(inside - low, minlength=width), values


def _counts(spark: SparkSession, replicates: int, draws: str, seed: int, n: int) -> DataFrame:
    """low, first, r and counts: how often replicate r, of the slice from ``first``, drew each cluster of the block from ``low`` (16 bits each); every replicate is drawn once."""

    step = SLICE if draws == "python" else DRAWN  # that generator can't skip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("id").to_pylist():
                for k, at in enumerate(DRAWS[draws](seed, n, first, min(first + step, replicates))):
                    counts = np.bincount(at, minlength=n)
                    if counts.max() >= 1 << 16:
                        raise OverflowError("a cluster was drawn more than 65,535 times")
                    counts, r = counts.astype(np.uint16), first + k
                    for low in range(0, n, BLOCK):
                        yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([r // SLICE * SLICE], pa.int32()), pa.array([r], pa.int32()), pa.array([counts[low : low + BLOCK].tobytes()], pa.binary())], ["low", "first", "r", "counts"])

    starts = spark.range(0, replicates, step, numPartitions=-(-replicates // step))
    return starts.mapInArrow(run, "low long, first int, r int, counts binary")


def resampled(moments: DataFrame, replicates: int, seed: int, draws: str = "hash") -> DataFrame:
    """r and totals (array of double): the sums of ``values`` over the clusters drawn in every replicate; r is -1 for all clusters once.

    ``moments``: one row per cluster, cluster_id and values, an array of double as long in every row.
    """
    blocks, n = _blocks(moments, replicates)
    row = lambda r, part: pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], ["r", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, counts, values in _each_slice(batches, draws, seed, n):
            yield row(r, counts @ values)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, drawn = batch.column("width")[k].as_py(), batch.column("drawn")[k].values
                values = batch.column("values")[k].values.to_numpy(zero_copy_only=False).reshape(width, -1)
                for r, counts in zip(drawn.field("r").to_pylist(), drawn.field("counts"), strict=True):
                    yield row(r, np.frombuffer(counts.as_buffer(), np.uint16) @ values)

    if n <= BLOCK:
        parts = blocks.mapInArrow(run, "r int, part array<double>")
    else:
        # A row holds a block's values and a slice's counts.
        counts = _counts(blocks.sparkSession, replicates, draws, seed, n).groupBy("low", "first").agg(F.collect_list(F.struct("r", "counts")).alias("drawn"))
        parts = blocks.select("low", "first", "width", "values").join(counts.hint("merge"), ["low", "first"]).mapInArrow(add_up, "r int, part array<double>")
    whole = moments.select(F.lit(-1).alias("r"), F.posexplode("values").alias("k", "v"))
    sums = parts.select("r", F.posexplode("part").alias("k", "v")).unionByName(whole).groupBy("r", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).select("r", F.transform("x", lambda x: x["v"]).alias("totals"))


def intervals(values: DataFrame, names: list[str], level: float = 0.95) -> DataFrame:
    """statistic, estimate (of r = -1), lower_v, upper_v, valid, undefined and status from one row per replicate; a null withholds the interval."""
    long = values.select("r", F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select("r", "x.*")
    drawn, tail = F.col("r") >= 0, (1 - level) / 2
    v, of = F.when(drawn, F.col("v")), F.count(F.when(drawn, 1))
    ok = of == F.count(v)
    return long.groupBy("statistic").agg(
        F.max(F.when(~drawn, F.col("v"))).alias("estimate"), F.when(ok, F.percentile(v, F.lit(tail))).alias("lower_v"), F.when(ok, F.percentile(v, F.lit(1 - tail))).alias("upper_v"),
        F.count(v).alias("valid"), (of - F.count(v)).alias("undefined"), F.when(ok, "ok").otherwise("withheld").alias("status"),
    )


def bootstrap(moments: DataFrame, statistics: Mapping[str, Callable[[Column], Column]], replicates: int = 2000, seed: int = 2027, level: float = 0.95, draws: str = "hash") -> DataFrame:
    """Intervals (see ``intervals``) of statistics that are functions of the sums of ``values`` over clusters; null is undefined."""
    values = resampled(moments, replicates, seed, draws).select("r", *(f(F.col("totals")).alias(n) for n, f in statistics.items()))
    return intervals(values, list(statistics), level)


def bootstrap_counts(
    moments: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], Mapping[str, float | None]], names: list[str], replicates: int = 2000, seed: int = 2027, level: float = 0.95, draws: str = "hash"
) -> DataFrame:
    """Intervals of any statistic: ``statistic`` takes how often each cluster was drawn and the clusters' values, in order of ids.

    It runs in the tasks, which hold all clusters; more than a block of them is refused, as only sums can be split.
    A result with other names, NaN or infinity is an error.
    """
    blocks, n = _blocks(moments, replicates)
    if n > BLOCK:
        raise ValueError(f"{n} clusters; a statistic of counts takes {BLOCK} at most, use sums")

    def checked(r: int, counts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        found = dict(statistic(counts, values))
        if sorted(found) != sorted(names) or any(v is not None and not np.isfinite(v) for v in found.values()):
            raise ValueError(f"replicate {r}: a statistic has the names {names} and is a finite number or None")
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([found[k]], pa.float64()) for k in names)], ["r", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (r, counts, values) in enumerate(_each_slice(batches, draws, seed, n)):
            if r == 0 and k == 0:
                yield checked(-1, np.ones(n, np.int64), values)
            yield checked(r, counts, values)

    return intervals(blocks.mapInArrow(run, "r int, " + ", ".join(f"`{k}` double" for k in names)), names, level)


def type_values(moments: DataFrame, scores: list[str], types: list[str]) -> DataFrame:
    """One row per cluster: k and the sums of every score for every type, zeros where a type isn't there."""
    cells = [F.coalesce(F.sum(F.when(F.col("probe_type") == t, F.col(c))), F.lit(0)).cast("double") for t in types for c in ("k", *scores)]
    return moments.groupBy("cluster_id").agg(F.array(*cells).alias("values"))


def weighted_mean(score: int, n_scores: int, weights: list[float]) -> Callable[[Column], Column]:
    """The weighted mean over types of the mean of problems; null if a type has none."""
    step = n_scores + 1
    return lambda totals: sum((F.lit(float(w)) * F.try_divide(totals[i * step + 1 + score], totals[i * step]) for i, w in enumerate(weights)), F.lit(0.0))


def cluster_bootstrap(
    probes: DataFrame, scores: Mapping[str, str], weights: Mapping[str, float], replicates: int = 2000, seed: int = 2027, level: float = 0.95, draws: str = "hash"
) -> DataFrame:
    """Intervals (see ``intervals``) of the hierarchical means of scores; with two scores also of second minus first."""
    names, types = list(scores), sorted(weights)
    moments = written(type_values(cluster_moments(probes, scores), names, types), "cluster-moments")
    statistics = {n: weighted_mean(k, len(names), [weights[t] for t in types]) for k, n in enumerate(names)}
    if len(names) == 2:
        a, b = statistics.values()
        statistics[f"{names[1]}_minus_{names[0]}"] = lambda totals: b(totals) - a(totals)
    return bootstrap(moments, statistics, replicates, seed, level, draws)
