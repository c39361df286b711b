"""Versions of objects in a partial order: the active one, and what keeps an object from having one.

A revision names the revisions it was made from, of which there may be several (a merge). The active revision is the only
one that no other was made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written


def _parents(revisions: DataFrame) -> DataFrame:
    return revisions.select("object", "rev", F.explode("parents").alias("parent")).where("parent IS NOT NULL").distinct()


def cyclic(links: DataFrame) -> DataFrame:
    """object of every cycle among ``links`` (object, rev, parent).

    Each round takes away the links to revisions that have no link of their own, and links past revisions with one link
    lead to what these link to, so long chains shorten by half. An order without cycles loses a link in every round; when
    none goes any more, what is left is on a cycle or hangs on one.
    """
    left = written(links.select("object", "rev", "parent"), "revision-links")
    n = left.count()
    while n:
        own = left.groupBy("object", F.col("rev").alias("parent")).agg(F.count(F.lit(1)).alias("links"), F.min("parent").alias("next"))
        met = left.join(own, ["object", "parent"])  # a parent without links ends here
        on = met.select("object", "rev", F.when((F.col("links") == 1) & (F.col("next") != F.col("parent")), F.col("next")).otherwise(F.col("parent")).alias("parent"))
        left = written(on.distinct(), "revision-links")
        before, n = n, left.count()
        if n == before and not _shrinks(left):
            break
    return left.select("object").distinct()


def _shrinks(left: DataFrame) -> bool:
    """Whether some link leads to a revision without links."""
    return left.join(left.select("object", F.col("rev").alias("parent")).distinct(), ["object", "parent"], "left_anti").limit(1).count() > 0


def resolve(revisions: DataFrame) -> DataFrame:
    """object, active (null if there is none) and code of every object of ``revisions`` (object, rev, parents: array).

    Codes: ``cycle``, ``fork`` (several revisions that nothing was made from), ``unknown_parent`` (the object lacks a
    revision that another names; that name is ignored otherwise), ``revision_twice``. The first that holds in the order
    revision_twice, cycle, fork, unknown_parent is given; only the last leaves an active revision.
    """
    links = _parents(revisions)
    known = revisions.select("object", "rev").distinct()
    inner = written(links.join(known.withColumnRenamed("rev", "parent"), ["object", "parent"], "left_semi").select("object", "rev", "parent"), "revision-links")
    heads = known.join(inner.select("object", F.col("parent").alias("rev")).distinct(), ["object", "rev"], "left_anti").groupBy("object").agg(F.count(F.lit(1)).alias("heads"), F.min("rev").alias("head"))
    unknown = links.join(known.withColumnRenamed("rev", "parent"), ["object", "parent"], "left_anti").select("object").distinct().withColumn("unknown", F.lit(True))
    twice = revisions.groupBy("object", "rev").agg(F.count(F.lit(1)).alias("n")).groupBy("object").agg(F.max("n").alias("copies"))
    loops = cyclic(inner).withColumn("cycle", F.lit(True))
    rows = twice.join(heads, "object", "left").join(loops, "object", "left").join(unknown, "object", "left")
    code = F.when(F.col("copies") > 1, "revision_twice").when(F.col("cycle"), "cycle").when(F.col("heads") > 1, "fork").when(F.col("unknown"), "unknown_parent")
    active = F.when((F.col("copies") == 1) & F.col("cycle").isNull() & (F.col("heads") == 1), F.col("head"))
    return rows.select("object", active.alias("active"), code.alias("code"))


def binding_issues(bindings: DataFrame, active: DataFrame) -> DataFrame:
    """observation, anchor and code where observations and anchors aren't bound one to one to what is active.

    ``bindings``: observation, anchor, object and rev (what the observation was read from). Codes: ``observation_twice``,
    ``anchor_twice``, ``no_active_version``, ``stale_version``; a binding has a row for each that holds.
    """
    twice = lambda key: bindings.groupBy(key).agg((F.count(F.lit(1)) > 1).alias(f"{key}_twice"))
    rows = bindings.join(twice("observation"), "observation").join(twice("anchor"), "anchor").join(active.select("object", "active"), "object", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("observation_twice"), "observation_twice"), F.when(F.col("anchor_twice"), "anchor_twice"), F.when(F.col("active").isNull(), "no_active_version"), F.when(F.col("active") != F.col("rev"), "stale_version")
    ))
    return rows.select("observation", "anchor", F.explode(codes).alias("code"))
