"""Literal worked examples of the scoring and aggregation rules."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.functions import audit, spans, strict_json
from plumbline.operators import pools
from plumbline.operators.components import connected_components


def frame(spark, rows):
    """(probe_type, problem_id, v) with nulls."""
    return spark.createDataFrame(rows, "probe_type string, problem_id string, v int")


def overall(spark, rows, weights):
    return pools.combine(pools.type_means(frame(spark, rows), "v"), weights).first()


def test_problems_weigh_the_same(spark):
    assert overall(spark, [("a", "many", 1)] * 20 + [("a", "few", 0)] * 4, {"a": 1}).value == 0.5


def test_type_before_problem_and_custom_weights(spark):
    rows = [("a", "m1", 1), ("a", "m2", 0)] + [("b", "m1", 0)] * 9
    assert overall(spark, rows, {"a": 0.5, "b": 0.5}).value == 0.25
    assert overall(spark, [("a", "m", 1), ("b", "m", 0)], {"a": 0.8, "b": 0.2}).value == pytest.approx(0.8)


def test_missing_service_bounds_the_value(spark):
    r = pools.type_means(frame(spark, [("a", "m1", None)] * 20 + [("a", "m2", 1)]), "v").first()
    assert (r.value, r.lower_v, r.upper_v, r.coverage, r.n_missing) == (None, 0.5, 1.0, 0.5, 20)


def test_a_lost_type_withholds_the_total_even_at_weight_zero(spark):
    assert overall(spark, [("a", "m", 1)], {"a": 1.0, "b": 0.0}).value is None


def test_quantities_are_exact():
    scales = {"kg": "1", "g": "1/1000", "m": "1", "cm": "1/100"}
    assert strict_json.same_quantity("2000 g", "2 kg", scales)
    assert strict_json.same_quantity("30.1 cm", "0.3 m", scales, "0.001") and not strict_json.same_quantity("30.1001 cm", "0.3 m", scales, "0.001")
    assert strict_json.quantity("1e-3 kg", scales) == Fraction(1, 1000) and strict_json.quantity("2 lb", scales) is None


def test_hypergeometric_bound():
    assert [audit.hypergeom_upper(*x) for x in ((521, 0, 0), (521, 521, 9), (0, 0, 0), (40, 1, 0))] == [521, 9, 0, 39]
    assert audit.hypergeom_upper(1000, 100, 0) < audit.hypergeom_upper(1000, 100, 2) < 1000
    from math import comb

    for n, s, k in ((12, 5, 1), (30, 10, 3), (41, 40, 0), (25, 3, 3)):
        plain = [d for d in range(k, n + 1) if 40 * sum(comb(d, i) * comb(n - d, s - i) for i in range(k + 1)) >= comb(n, s)]
        assert audit.hypergeom_upper(n, s, k) == max(plain)


def test_spans(spark):
    rows = [("aaaa", "aa", 2), ("xa\U0001f600a", "a", 2), ("once", "nc", 5), ("abab", "ab", 9), ("abc", "z", 1), ("abc", "", 1)]
    got = spark.createDataFrame(rows, "t string, q string, n int").select(spans.resolve(F.col("t"), F.col("q"), F.col("n")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [
        ("resolved_exact", 2, 4), ("resolved_exact", 3, 4), ("unique_exact_repair_proposed", 1, 3), ("ambiguous_occurrence", None, None), ("quote_not_found", None, None), ("quote_not_found", None, None),
    ]


def test_components_of_cycles_chains_and_loops(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (4, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 4: 4}


def test_greedy_cover_matches_a_plain_loop(spark):
    import random

    from plumbline.operators.cover import greedy_cover

    rng = random.Random(6)
    tags = [(rng.randrange(12), rng.randrange(40)) for _ in range(90)]
    left, want = {i: {t for j, t in tags if j == i} for i in range(12)}, []
    for rank in range(1, 9):
        item = min(left, key=lambda i: (-len(left[i]), i))
        if not left[item]:
            break
        want.append((rank, item, len(left[item])))
        gone = left[item]
        left = {i: s - gone for i, s in left.items()}
    assert [tuple(r) for r in greedy_cover(spark.createDataFrame(tags, "item long, tag long"), 8).orderBy("rank").collect()] == want
