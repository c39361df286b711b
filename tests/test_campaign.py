"""A campaign against plain loops, over random reviews."""

import hashlib
import random

import pytest

from plumbline.functions.audit import hypergeom_upper
from plumbline.operators import campaign

POLICY = campaign.Policy(sample=12, secondary=4, risk=3, limit=20)


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def world(rng, mothers=60):
    catalog = {m: [m * 10 + k for k in range(rng.randint(1, 4))] for m in range(mothers)}
    tags = {m: {f"source{rng.randrange(4)}", f"rule{min(rng.randrange(30), 9)}"} for m in catalog}
    return catalog, tags


def frames(spark, catalog, tags):
    items = spark.createDataFrame([(m, i) for m, xs in catalog.items() for i in xs], "mother long, item long").repartition(3)
    return items, spark.createDataFrame([(m, t) for m, ts in tags.items() for t in ts], "mother long, tag string")


def plain_plan(catalog, tags, nonce, number):
    seed = f"{nonce}:{number}"
    sample = sorted(catalog, key=lambda m: sha(seed, "draw", m))[: POLICY.sample]
    second = sorted(sample, key=lambda m: sha(seed, "second", m))[: POLICY.secondary]
    every, covered, risk = set().union(*tags.values()), set().union(*(tags[m] for m in sample)), []
    while len(risk) < POLICY.risk and every - covered:
        best = min((m for m in catalog if m not in sample and m not in risk), key=lambda m: (-len(tags[m] - covered), sha(seed, "risk", m)))
        risk.append(best)
        covered |= tags[best]
    first = {m: min(catalog[m], key=lambda i: sha(seed, "first", i)) for m in sample + risk}
    return sample, second, risk, first, every - covered


def some_reviews(rng, catalog, plan):
    sample, second, risk, first, _ = plan
    out = {"primary": {}, "secondary": {}, "adjudication": {}}
    for m in sample + risk:
        order = sorted(catalog[m], key=lambda i: i != first[m])
        for role, who in (("primary", "ann"), ("secondary", "bob")):
            if role == "secondary" and m not in second and rng.random() < 0.4:
                continue
            for k, i in enumerate(order):
                draw = rng.random()
                verdict = ("approved", "none") if draw < 0.82 else ("pending", None) if draw < 0.84 else ("rejected", rng.choice(("minor", "serious", "systemic", "unresolved")))
                out[role][i] = (*verdict, who, k)
        for i in catalog[m]:
            a, b = out["primary"][i], out["secondary"].get(i)
            apart = a[0] != "pending" and ((b and b[0] != "pending" and a[:2] != b[:2]) or a[1] == "unresolved" or (b and b[1] == "unresolved"))
            if apart and rng.random() < 0.7:
                out["adjudication"][i] = (rng.choice(("approved", "rejected")), rng.choice(("none", "serious")), "cid", 0)
    return out


def plain_assessment(catalog, plan, reviews):
    sample, second, risk, first, uncovered = plan
    a_of, b_of, c_of = (reviews[r] for r in ("primary", "secondary", "adjudication"))
    flagged, serious, bad, systemic, unresolved, missed = set(), set(), set(), set(), set(), False
    for m in sample + risk:
        for i in catalog[m]:
            a, b, c = a_of.get(i), b_of.get(i), c_of.get(i)
            for x in (a, b):
                if x and x[0] == "rejected":
                    flagged.add(m)
                    serious |= {m} if x[1] in campaign.SERIOUS else set()
                    systemic |= {i} if x[1] in campaign.SYSTEMIC else set()
            missed |= bool(b and b[1] in campaign.SERIOUS and not (a and a[1] in campaign.SERIOUS))
            if not a or a[0] == "pending":
                continue
            apart = (b and b[0] != "pending" and a[:2] != b[:2]) or a[1] == "unresolved" or (b and b[1] == "unresolved")
            if apart and not c:
                unresolved.add(i)
                continue
            final = c if apart else a
            if final[1] in campaign.SYSTEMIC:
                systemic.add(i)
            if final[0] == "rejected" and final[1] == "serious":
                bad.add(m)
                serious.add(m)
            elif final[0] == "rejected":
                unresolved.add(i)
    required = set(sample + risk) if missed else set(second) | flagged
    pending = lambda of, ms: sum((of.get(i) or ("pending",))[0] == "pending" for m in ms for i in catalog[m])
    k, n = len(serious & set(sample)), len(catalog)
    upper = max(hypergeom_upper(n, len(sample), k), len(bad))
    return {
        "candidates": n, "sampled": len(sample), "risk_extra": len(risk), "reviewed_twice": len(required), "escalated": missed, "found": k, "removed": len(bad), "upper_bound": upper, "uncovered": len(uncovered),
        "pending_primary": pending(a_of, sample + risk), "pending_secondary": pending(b_of, required), "unresolved": len(unresolved), "systemic": len(systemic),
    }


def review_frame(spark, reviews):
    rows = [(i, role, *v) for role, of in reviews.items() for i, v in of.items()]
    return spark.createDataFrame(rows, "item long, role string, status string, severity string, reviewer string, sequence int")


@pytest.mark.parametrize("seed", range(3))
def test_a_round_is_that_of_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    catalog, tags = world(rng)
    plan = plain_plan(catalog, tags, f"n{seed}", 1 + seed % 2)
    of = campaign.plan_round(*frames(spark, catalog, tags), f"n{seed}", 1 + seed % 2, POLICY)
    sample, second, risk, first, uncovered = plan
    assert {(r.mother, r.part, r.second) for r in of.mothers.collect()} == {(m, "sample", m in second) for m in sample} | {(m, "risk", False) for m in risk}
    assert {r.item for r in of.items.where("blind_first").collect()} == set(first.values()) and {r.tag for r in of.uncovered.collect()} == uncovered
    reviews = some_reviews(rng, catalog, plan)
    got, want = campaign.assess(of, review_frame(spark, reviews), POLICY), plain_assessment(catalog, plan, reviews)
    assert {k: got[k] for k in want} == want
    assert got["accepted"] == (got["blockers"] == "") and got["complete"] == (not (want["pending_primary"] or want["pending_secondary"] or want["unresolved"]))


def clean(catalog, plan, bad=()):
    sample, second, risk, first, _ = plan
    order = {m: sorted(catalog[m], key=lambda i: i != first[m]) for m in sample + risk}
    out = {"primary": {}, "secondary": {}, "adjudication": {}}
    for m, items in order.items():
        for k, i in enumerate(items):
            verdict = ("rejected", "serious") if i in bad else ("approved", "none")
            out["primary"][i] = (*verdict, "ann", k)
            if m in second or any(j in bad for j in items):
                out["secondary"][i] = (*verdict, "bob", k)
    return out


def test_acceptance_protocol_and_retry(spark):
    rng = random.Random(7)
    catalog, tags = world(rng, 60)
    tags = {m: {"one"} for m in catalog}
    policy = campaign.Policy(sample=55, secondary=4, risk=3, limit=20)
    items, tag_rows = frames(spark, catalog, tags)
    of = campaign.plan_round(items, tag_rows, "n", 1, policy)
    rows = of.mothers.collect()
    plan = [r.mother for r in rows], [r.mother for r in rows if r.second], [], {r.mother: r.item for r in of.items.where("blind_first").collect()}, set()
    good = clean(catalog, plan)
    assert campaign.assess(of, review_frame(spark, good), policy)["accepted"] and campaign.protocol_issues(of, review_frame(spark, good)).count() == 0
    some = plan[0][:6]
    worse = clean(catalog, plan, {catalog[m][0] for m in some})
    doubtful = hypergeom_upper(60, 55, 6) - 6
    assert campaign.assess(of, review_frame(spark, worse), policy)["blockers"] == ("bound_above_limit" if doubtful * 20 > 54 else "")
    # Broken rules, one for each.
    many = next(m for m in plan[0] if len(catalog[m]) > 2 and m not in plan[1] and m not in some)
    broken = {r: dict(x) for r, x in worse.items()}
    a, b, c = catalog[many][:3]
    for k, i in enumerate(sorted(catalog[many], key=lambda i: i == plan[3][many])):
        broken["primary"][i] = ("approved", "none", "ann" if i != a else "eve", k)
    broken["secondary"][a] = ("approved", "none", "eve", None)
    broken["adjudication"][b] = ("approved", "none", "ann", 0)
    broken["primary"][-5] = ("approved", "none", "ann", 0)
    codes = {r.code for r in campaign.protocol_issues(of, review_frame(spark, broken)).collect()}
    assert codes == {"out_of_sample", "second_not_independent", "needless_adjudication", "adjudicator_not_independent", "several_reviewers", "no_sequence", "blind_first_not_first"}
    # The second catalog: one rejected mother gone, one changed, the others as they were.
    old = items.selectExpr("mother", "item", "'r' || item % 5 AS rule", "sha2(cast(item AS string), 256) AS content")
    new = old.where(f"mother <> {some[0]}").selectExpr("mother", "item", "rule", f"CASE WHEN mother = {some[1]} THEN 'new' ELSE content END AS content")
    assert {tuple(r) for r in campaign.retry_issues(of, review_frame(spark, worse), old, new).collect()} == {(m, "rejected") for m in some[2:]}
    with pytest.raises(ValueError, match="at most"):
        campaign.plan_round(items, tag_rows, "n", 3, policy)
