"""Candidates of probes derived anew from the graph and compared with what is stored, privately and publicly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(*parts) -> Column:
    return F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def derived(probes: DataFrame, entities: DataFrame, seed: str) -> DataFrame:
    """probe, target, alias and place of all candidates, as the graph gives them.

    ``probes``: probe, problem and kinds (array; null allows any). ``entities``: problem, entity, kind and visual. Candidates are the
    entities of the problem that can be seen and are of an allowed kind. Aliases E1, E2... go by one hash, places from 1 by
    another, so neither tells anything. Windows hold the entities of one probe.
    """
    pool = probes.join(entities.where("visual"), "problem").where(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind"))).select("probe", F.col("entity").cast("string").alias("target")).distinct()
    own = Window.partitionBy("probe")
    named = pool.withColumn("alias", F.concat(F.lit("E"), F.row_number().over(own.orderBy(_hash(seed, F.col("probe"), "alias", F.col("target")), "target"))))
    return named.withColumn("place", F.row_number().over(own.orderBy(_hash(seed, F.col("probe"), "place", F.col("alias")), "alias")))


def candidate_issues(want: DataFrame, key: DataFrame, view: DataFrame, public: DataFrame) -> DataFrame:
    """probe, subject and code wherever stored candidates aren't those of the graph or the public side tells too much.

    ``want``: see ``derived``. ``key``: the private map, probe, alias, target. ``view``: what is shown, probe, alias, place.
    ``public``: probe and text, all that a reader sees. Codes by target: ``lost``, ``extra``, ``alias_differs``, ``leak`` (its name stands
    in the text as a word); by alias: ``not_shown``, ``not_mapped``, ``alias_twice``, ``place_differs``.
    """
    key, out = key.select("probe", "alias", "target"), []

    def put(rows: DataFrame, subject: str, code: Column) -> None:
        out.append(rows.select("probe", F.col(subject).alias("subject"), code.alias("code")).where("code IS NOT NULL"))

    both = want.select("probe", "target", F.col("alias").alias("a")).join(key.select("probe", "target", F.col("alias").alias("b")), ["probe", "target"], "full_outer")
    put(both, "target", F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "alias_differs"))
    mapped = key.groupBy("probe", "alias").agg(F.count(F.lit(1)).alias("n"))
    shown = view.groupBy("probe", "alias").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
    closed = mapped.join(shown, ["probe", "alias"], "full_outer")
    put(closed, "alias", F.when(F.col("times").isNull(), "not_shown").when(F.col("n").isNull(), "not_mapped").when((F.col("n") > 1) | (F.col("times") > 1), "alias_twice"))
    put(shown.join(want.select("probe", "alias", F.col("place").alias("due")), ["probe", "alias"]), "alias", F.when(F.col("place") != F.col("due"), "place_differs"))
    # Names are compared as words of the text: one array per probe, no pattern per target.
    told = public.select("probe", F.array_distinct(F.split("text", "[^A-Za-z0-9_-]+")).alias("words"))
    put(key.select("probe", "target").distinct().join(told, "probe"), "target", F.when(F.array_contains("words", F.col("target")), "leak"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
