"""Roots of record sets: a tree of digests over buckets of ids, so that what changed is found by descending.

A record's digest leaves volatile fields out. Buckets go by the first hex digits of the id's digest; a bucket's node is the
digest of the sums of its records' digests (eight words each, modulo 2**64) and their number, which partial aggregation
adds up in any order: roots depend neither on partitioning nor on order, and no bucket is ever collected. Above, a node is
the digest of its up to 16 children. Sums find changes and mistakes; they are no defence against someone who looks for collisions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.variants import members

from .components import written

#: Changed buckets up to this many are looked up by value in the records' own order; more are joined.
FEW = 1000


def columns_digest(df: DataFrame, volatile: tuple[str, ...] = ()) -> Column:
    """Digest of a row: canonical JSON of its columns in the order of names, without the volatile ones; nulls are kept."""
    names = sorted(c for c in df.columns if c not in volatile)
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}), 256)


def record_digest(record: Column, volatile: tuple[str, ...] = ()) -> Column:
    """Digest of a JSON object's text without its volatile members: keys in order, no blanks. Null for what is no object."""
    kept = F.map_filter(members(F.try_parse_json(record)), lambda k, _: ~k.isin(list(volatile)) if volatile else F.lit(True))
    return F.sha2(F.to_json(kept), 256)


@dataclass
class Snapshot:
    """``leaves`` (bucket, id, digest), written in the order of buckets, and ``nodes`` (depth, prefix, digest, n), the root at depth 0."""

    leaves: DataFrame
    nodes: DataFrame
    depth: int

    def root(self) -> str:
        return self.nodes.where("depth = 0").first()["digest"]


def snapshot(leaves: DataFrame, depth: int = 2) -> Snapshot:
    """The tree over ``leaves`` (id, digest). A repeated id is a record of its own each time; a null digest counts as a text of its own.

    ``depth``: with 16 ** depth buckets; choose it so that a bucket has some hundreds of records.
    """
    rows = leaves.select(F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), 256), 1, depth).alias("bucket"), "id", F.coalesce("digest", F.lit("null")).alias("digest"))
    rows = written(rows.repartitionByRange("bucket", "id", "digest").sortWithinPartitions("bucket", "id"), "root-leaves")
    whole = F.sha2("digest", 256)
    words = [F.sum(F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)]
    level = rows.groupBy(F.col("bucket").alias("prefix")).agg(F.sha2(F.concat_ws(":", *words, F.count(F.lit(1))), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    level = written(level.select(F.lit(depth).alias("depth"), "prefix", "digest", "n"), "root-nodes")
    nodes = [level]
    for d in range(depth - 1, -1, -1):
        child = F.concat(F.substring("prefix", d + 1, 1), F.col("digest"))
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ""), 256).alias("digest"), F.sum("n").alias("n"))
        nodes.append(level.select(F.lit(d).alias("depth"), "prefix", "digest", "n"))
    return Snapshot(rows, written(reduce(DataFrame.unionByName, nodes), "root-nodes"), depth)


def changed_buckets(a: Snapshot, b: Snapshot) -> DataFrame:
    """prefix of every bucket that differs, found from the root down: below a node that is the same nothing is looked at."""
    open_, d = None, 0
    while True:
        x, y = (s.nodes.where(F.col("depth") == d).select("prefix", F.col("digest").alias(n)) for s, n in ((a, "x"), (b, "y")))
        if open_ is not None:
            x, y = (t.join(open_, F.substring("prefix", 1, d - 1) == F.col("above"), "left_semi") for t in (x, y))
        differ = written(x.join(y, "prefix", "full_outer").where("NOT (x <=> y)").select("prefix"), "root-changes")
        if d == a.depth or not differ.limit(1).count():
            return differ
        open_, d = differ.withColumnRenamed("prefix", "above"), d + 1


def changes(a: Snapshot, b: Snapshot) -> DataFrame:
    """id and code (added, removed, changed) of the records of ``b`` that aren't as in ``a``; only differing buckets are read.

    For repeated ids whole sets of digests are compared.
    """
    if a.depth != b.depth:
        raise ValueError("snapshots of one depth are compared")
    buckets = changed_buckets(a, b)
    few = [r.prefix for r in buckets.limit(FEW + 1).collect()]

    def inside(s: Snapshot, name: str) -> DataFrame:
        rows = s.leaves.where(F.col("bucket").isin(few)) if len(few) <= FEW else s.leaves.join(buckets.withColumnRenamed("prefix", "bucket"), "bucket", "left_semi")
        copies = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
        return copies.select(F.struct("id").alias("key"), "digest", F.col("copies").alias(name))

    both = inside(a, "x").join(inside(b, "y"), ["key", "digest"], "full_outer").groupBy("key").agg(
        F.max(F.when(~F.col("x").eqNullSafe(F.col("y")), 1)).alias("differ"), F.count("x").alias("before"), F.count("y").alias("after")
    )
    return both.where("differ = 1").select("key.id", F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").otherwise("changed").alias("code"))
