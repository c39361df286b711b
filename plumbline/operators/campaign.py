"""Audit campaigns: which mothers are looked at, what the reviews say, and whether the batch is accepted.

A round draws mothers by hash without replacement, has part of them reviewed twice, and adds mothers that
cover risks the draw missed. A serious defect counts once per mother, whatever becomes of it later; the exact bound
on all mothers decides with the reviews' completeness. There are two rounds at most, and what failed in the first has to change before the second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.audit import hypergeom_upper

from .components import written
from .cover import greedy_cover

#: Severities that make a mother defective, and those that speak against a whole rule (fixed values).
SERIOUS, SYSTEMIC = ("serious", "systemic", "information"), ("systemic", "information")
ROUNDS = 2


@dataclass(frozen=True)
class Policy:
    """Mothers drawn, mothers of these reviewed twice, most mothers added for risks, and the largest share of defective ones as 1 / ``limit``."""

    sample: int = 100
    secondary: int = 25
    risk: int = 20
    limit: int = 20


@dataclass
class Round:
    """``mothers``: mother, part (sample or risk), second; ``items``: those of these mothers with blind_first; ``uncovered``: risk tags that nobody looks at."""

    number: int
    seed: str
    candidates: int
    mothers: DataFrame
    items: DataFrame
    uncovered: DataFrame


def _hash(*parts) -> Column:
    return F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def plan_round(catalog: DataFrame, tags: DataFrame, nonce: str, number: int, policy: Policy = Policy()) -> Round:  # noqa: B008
    """A round over ``catalog`` (mother, item) with the risks ``tags`` (mother, tag). Nothing but nonce and number moves the draw."""
    if not 1 <= number <= ROUNDS:
        raise ValueError(f"{ROUNDS} rounds at most")
    seed, mother = f"{nonce}:{number}", F.col("mother")
    every = written(catalog.select("mother").distinct(), "audit-every")
    sample = written(every.orderBy(_hash(seed, "draw", mother), "mother").limit(policy.sample), "audit-sample")
    twice = written(sample.orderBy(_hash(seed, "second", mother), "mother").limit(policy.secondary), "audit-second")
    seen = tags.join(F.broadcast(sample), "mother", "left_semi").select("tag").distinct()
    missed = tags.join(F.broadcast(seen), "tag", "left_anti").join(every, "mother", "left_semi")  # what the sample shows goes first: that is most
    missed = written(missed.select(mother.alias("item"), "tag"), "audit-risks")
    extra = greedy_cover(missed, policy.risk, lambda m: _hash(seed, "risk", m)).select(F.col("item").alias("mother"))
    covered = missed.join(F.broadcast(extra.withColumnRenamed("mother", "item")), "item", "left_semi").select("tag").distinct()
    mothers = sample.select("mother", F.lit("sample").alias("part")).unionByName(extra.select("mother", F.lit("risk").alias("part")))
    mothers = written(mothers.join(F.broadcast(twice.withColumn("second", F.lit(True))), "mother", "left").fillna(False, ["second"]), "audit-mothers")
    items = catalog.join(F.broadcast(mothers), "mother").select("mother", "item", "part", "second")
    first = items.groupBy("mother").agg(F.min_by("item", F.struct(_hash(seed, "first", F.col("item")), "item")).alias("first"))
    items = written(items.join(first, "mother").select("mother", "item", "part", "second", (F.col("item") == F.col("first")).alias("blind_first")), "audit-items")
    return Round(number, seed, every.count(), mothers, items, missed.select("tag").distinct().join(covered, "tag", "left_anti"))


def _in(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def findings(of: Round, reviews: DataFrame) -> DataFrame:
    """The items of a round with what both reviews and an adjudication make of them.

    ``reviews``: item, role (primary, secondary, adjudication), status (approved, rejected, pending), severity, reviewer and
    sequence. A disagreement or an unresolved severity stays open without an adjudication; with one, that decides.
    """
    fields = ("status", "severity", "reviewer", "sequence")
    rows, reviews = of.items, reviews.join(F.broadcast(of.items.select("item")), "item", "left_semi")  # a round has few items
    for role, p in (("primary", "a"), ("secondary", "b"), ("adjudication", "c")):
        rows = rows.join(reviews.where(F.col("role") == role).select("item", *(F.col(f).alias(f"{p}_{f}") for f in fields)), "item", "left")
    done = {p: F.coalesce(F.col(f"{p}_status") != "pending", F.lit(False)) for p in "abc"}
    hit = {p: F.coalesce(F.col(f"{p}_status") == "rejected", F.lit(False)) for p in "ab"}
    same = (F.col("a_status") == F.col("b_status")) & F.col("a_severity").eqNullSafe(F.col("b_severity"))
    apart = done["a"] & ((done["b"] & ~same) | _in("a_severity", ("unresolved",)) | _in("b_severity", ("unresolved",)))
    judged = apart & F.col("c_status").isNotNull()
    final = {f: F.when(judged, F.col(f"c_{f}")).when(done["a"] & ~apart, F.col(f"a_{f}")) for f in ("status", "severity")}
    rejected = F.coalesce(final["status"] == "rejected", F.lit(False))
    grave = F.coalesce(final["severity"] == "serious", F.lit(False))
    systemic = (hit["a"] & _in("a_severity", SYSTEMIC)) | (hit["b"] & _in("b_severity", SYSTEMIC)) | F.coalesce(final["severity"].isin(*SYSTEMIC), F.lit(False))
    return rows.select(
        "mother", "item", "part", "second", "blind_first", "a_reviewer", "b_reviewer", "c_reviewer", "a_sequence", "b_sequence",
        done["a"].alias("a_done"), done["b"].alias("b_done"), (hit["a"] | hit["b"]).alias("flagged"), apart.alias("apart"), F.col("c_status").isNotNull().alias("c_done"),
        ((hit["a"] & _in("a_severity", SERIOUS)) | (hit["b"] & _in("b_severity", SERIOUS)) | (rejected & grave)).alias("serious"),
        (_in("b_severity", SERIOUS) & ~_in("a_severity", SERIOUS)).alias("missed"), systemic.alias("systemic"), (rejected & grave).alias("bad"),
        ((apart & ~judged) | (rejected & ~grave)).alias("open"),
    )


def protocol_issues(of: Round, reviews: DataFrame) -> DataFrame:
    """mother, item and code wherever reviewers broke the rules of a round; such a round is to be done again, not assessed."""
    f = findings(of, reviews)
    item = lambda bad, code: f.where(bad).select("mother", "item", F.lit(code).alias("code"))
    out = [
        reviews.join(of.items.select("item"), "item", "left_anti").select(F.lit(None).cast(f.schema["mother"].dataType).alias("mother"), "item", F.lit("out_of_sample").alias("code")),
        item((F.col("a_done") & F.col("b_done")) & (F.col("a_reviewer") == F.col("b_reviewer")), "second_not_independent"),
        item("c_done AND a_done AND NOT apart", "needless_adjudication"),
        item("c_done AND (c_reviewer = a_reviewer OR c_reviewer = coalesce(b_reviewer, ''))", "adjudicator_not_independent"),
    ]
    for p in "ab":
        mine = f.where(f"{p}_done").select("mother", "item", "blind_first", F.col(f"{p}_reviewer").alias("who"), F.col(f"{p}_sequence").alias("seq"))
        g = mine.groupBy("mother").agg(
            F.countDistinct("who").alias("people"), F.count(F.when(F.col("seq").isNull(), 1)).alias("unnumbered"), F.count("seq").alias("n"), F.countDistinct("seq").alias("places"), F.min_by("blind_first", "seq").alias("first_ok")
        )
        codes = F.array_compact(F.array(
            F.when(F.col("people") > 1, "several_reviewers"), F.when(F.col("unnumbered") > 0, "no_sequence"), F.when(F.col("places") < F.col("n"), "sequence_twice"), F.when(~F.col("first_ok"), "blind_first_not_first")
        ))
        out.append(g.select("mother", F.lit(None).cast(f.schema["item"].dataType).alias("item"), F.explode(codes).alias("code")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.distinct()


def assess(of: Round, reviews: DataFrame, policy: Policy = Policy()) -> dict:  # noqa: B008
    """What a round comes to: the counts, the bound, the blockers and whether all is well. No more than a row of sums leaves Spark."""
    f = written(findings(of, reviews), "audit-findings")
    escalated = f.where("missed").limit(1).count() > 0
    flag = lambda c: F.max(F.col(c).cast("int"))
    need = f.groupBy("mother").agg(((flag("second") + flag("flagged")) > 0).alias("needed"), F.first("part").alias("part"), flag("serious").alias("serious"), flag("bad").alias("bad"))
    rows = f.join(F.broadcast(need.select("mother", "needed")), "mother").agg(
        F.count(F.when(~F.col("a_done"), 1)).alias("pending_primary"), F.count(F.when((F.col("needed") | F.lit(escalated)) & ~F.col("b_done"), 1)).alias("pending_secondary"),
        F.count(F.when(F.col("open"), 1)).alias("open"), F.count(F.when(F.col("systemic"), 1)).alias("systemic"),
    ).first()
    mothers = need.agg(
        F.count(F.when(F.col("part") == "sample", 1)).alias("sampled"), F.count(F.when(F.col("part") == "risk", 1)).alias("risk"), F.count(F.when(F.col("needed") | F.lit(escalated), 1)).alias("second"),
        F.coalesce(F.sum(F.when(F.col("part") == "sample", F.col("serious"))), F.lit(0)).alias("found"), F.coalesce(F.sum("bad"), F.lit(0)).alias("removed"),
    ).first()
    n, k, removed = mothers["sampled"], int(mothers["found"]), int(mothers["removed"])
    upper = max(hypergeom_upper(of.candidates, n, k), removed)
    left, doubtful = of.candidates - removed, upper - removed
    uncovered = of.uncovered.count()
    blockers = {
        "primary_incomplete": rows["pending_primary"], "secondary_incomplete": rows["pending_secondary"], "unresolved": rows["open"], "systemic": rows["systemic"],
        "risks_uncovered": uncovered, "bound_above_limit": int(not (left > 0 and doubtful * policy.limit <= left)),
    }
    return {
        "round": of.number, "candidates": of.candidates, "sampled": n, "risk_extra": mothers["risk"], "reviewed_twice": mothers["second"], "escalated": escalated, "found": k, "removed": removed,
        "upper_bound": upper, "remaining": left, "pending_primary": rows["pending_primary"], "pending_secondary": rows["pending_secondary"], "unresolved": rows["open"], "systemic": rows["systemic"], "uncovered": uncovered,
        "complete": not (rows["pending_primary"] or rows["pending_secondary"] or rows["open"]), "blockers": ",".join(b for b, n in blockers.items() if n), "accepted": not any(blockers.values()),
    }


def retry_issues(of: Round, reviews: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """mother, why: what the first round found and the second catalog still has unchanged.

    ``old`` and ``new``: mother, item, rule and content (a digest of what is reviewed). A rejected mother has to be gone or
    to differ in some item; a systemic finding speaks against every mother with an item of the same rule.
    """
    f = written(findings(of, reviews), "audit-findings")
    rejected = f.where("flagged OR bad").select("mother", F.lit("rejected").alias("why"))
    rules = f.where("systemic AND flagged").select("item").join(old, "item").select("rule").distinct()
    affected = old.join(rules, "rule", "left_semi").select("mother", F.lit("systemic").alias("why"))
    known = rejected.unionByName(affected).groupBy("mother").agg(F.min("why").alias("why"))
    states = old.select("mother", "content", F.lit(1).alias("side")).unionByName(new.select("mother", "content", F.lit(2).alias("side"))).join(known, "mother", "left_semi")
    sets = states.groupBy("mother", "content").agg(F.max((F.col("side") == 1).cast("int")).alias("before"), F.max((F.col("side") == 2).cast("int")).alias("after"))
    same = sets.groupBy("mother").agg(F.min((F.col("before") == F.col("after")).cast("int")).alias("same"), F.max("after").alias("there")).where("same = 1 AND there = 1")
    return known.join(same.select("mother"), "mother", "left_semi").select("mother", "why")
