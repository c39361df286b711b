"""Intervals against a plain loop over replicates, with both kinds of draws."""

import hashlib
import random
from statistics import median

import numpy as np
import pytest

from plumbline.operators import bootstrap


def plain_draws(kind, n, replicates, seed):
    rng, ids = random.Random(seed), range(n)
    for r in range(replicates):
        if kind == "python":
            yield [rng.choice(ids) for _ in ids]
        else:
            words = [hashlib.sha256(f"{seed}:{r}:{s // 8}".encode()).hexdigest()[8 * (s % 8) :][:8] for s in ids]
            yield [int(w, 16) % n for w in words]


@pytest.mark.parametrize("kind", ["hash", "python"])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_draws_are_those_of_a_plain_loop(kind, n):
    want = list(plain_draws(kind, n, 9, 5))
    assert [d.tolist() for d in bootstrap.DRAWS[kind](5, n, 0, 9)] == want
    assert [d.tolist() for d in bootstrap.DRAWS[kind](5, n, 4, 7)] == want[4:7]


def interval(values, level=0.95):
    at = lambda p: float(np.quantile(sorted(values), p))
    return at((1 - level) / 2), at((1 + level) / 2)


@pytest.mark.parametrize("kind", ["hash", "python"])
def test_sums_in_several_blocks(spark, monkeypatch, kind):
    """Ids in another order than rows, more clusters than a block, more replicates than a slice."""
    monkeypatch.setattr(bootstrap, "BLOCK", 16)
    monkeypatch.setattr(bootstrap, "SLICE", 7)
    rng = random.Random(4)
    rows = [(f"c{i:03d}", [float(rng.randint(1, 9)), float(rng.randint(0, 5))]) for i in range(50)]
    shuffled = rng.sample(rows, len(rows))
    moments = spark.createDataFrame(shuffled, "cluster_id string, values array<double>").repartition(3)
    got = {r["statistic"]: r for r in bootstrap.bootstrap(moments, {"ratio": lambda t: t[1] / t[0], "sum": lambda t: t[1]}, 40, 11, draws=kind).collect()}
    draws = [np.array([rows[i][1] for i in d]).sum(0) for d in plain_draws(kind, 50, 40, 11)]
    whole = np.array([v for _, v in rows]).sum(0)
    for name, f in (("ratio", lambda t: t[1] / t[0]), ("sum", lambda t: t[1])):
        low, high = interval([f(t) for t in draws])
        r = got[name]
        assert (r.estimate, r.lower_v, r.upper_v) == pytest.approx((f(whole), low, high), rel=1e-12) and (r.valid, r.undefined, r.status) == (40, 0, "ok")


def test_a_replicate_is_drawn_once_however_many_blocks(spark, monkeypatch, tmp_path):
    """What a replicate costs grows with the clusters, not with clusters times blocks."""
    monkeypatch.setattr(bootstrap, "BLOCK", 8)
    log, hashed = str(tmp_path / "draws"), bootstrap.hash_draws

    def counted(seed, n, first, last):
        with open(log, "a") as out:
            out.writelines(f"{r}\n" for r in range(first, last))
        yield from hashed(seed, n, first, last)

    monkeypatch.setitem(bootstrap.DRAWS, "counted", counted)
    moments = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "cluster_id long, values array<double>")
    got = {r.r: r.totals for r in bootstrap.resampled(moments, 30, 7, "counted").collect()}
    want = {r: [50.0, float(sum(d))] for r, d in enumerate(plain_draws("hash", 50, 30, 7))}
    assert got == want | {-1: [50.0, float(sum(range(50)))]}
    assert sorted(map(int, open(log))) == list(range(30))


def test_a_statistic_that_is_no_function_of_sums(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "SLICE", 6)
    rng = random.Random(8)
    rows = [(i, [rng.random()]) for i in range(30)]
    moments = spark.createDataFrame(rows, "cluster_id long, values array<double>")

    def statistic(counts, values):
        drawn = sorted(v for c, v in zip(counts, values[:, 0], strict=True) for _ in range(c))
        return {"median": float(drawn[len(drawn) // 2]), "rare": None if counts[3] == 0 else 1.0}

    got = {r["statistic"]: r for r in bootstrap.bootstrap_counts(moments, statistic, ["median", "rare"], 25, 3, draws="python").collect()}
    draws = list(plain_draws("python", 30, 25, 3))
    low, high = interval([sorted(rows[i][1][0] for i in d)[15] for d in draws])
    assert (got["median"].lower_v, got["median"].upper_v, got["median"].estimate) == pytest.approx((low, high, sorted(v[0] for _, v in rows)[15]))
    lost = sum(3 not in d for d in draws)
    assert lost and (got["rare"].undefined, got["rare"].valid, got["rare"].status, got["rare"].lower_v) == (lost, 25 - lost, "withheld", None)
    assert median(v[0] for _, v in rows) <= got["median"].upper_v


def test_what_a_statistic_may_not_do(spark, monkeypatch):
    moments = spark.createDataFrame([(i, [1.0]) for i in range(4)], "cluster_id long, values array<double>")
    for wrong in (lambda c, v: {"other": 1.0}, lambda c, v: {"x": float("nan")}):
        with pytest.raises(Exception, match="finite number or None"):
            bootstrap.bootstrap_counts(moments, wrong, ["x"], 5, 1).collect()
    monkeypatch.setattr(bootstrap, "BLOCK", 3)
    with pytest.raises(ValueError, match="at most"):
        bootstrap.bootstrap_counts(moments, lambda c, v: {"x": 1.0}, ["x"], 5, 1)


def test_clusters_are_drawn_whole_and_undefined_intervals_withheld(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, 0), (1, "a", 2, 0, 1), (2, "a", 3, 1, 1)], "cluster_id long, probe_type string, problem_id long, x int, y int")
    rows = {r.statistic: r for r in bootstrap.cluster_bootstrap(df, {"x": "x", "y": "y"}, {"a": 1.0}, replicates=50).collect()}
    assert rows["x"].estimate == pytest.approx(2 / 3) and rows["x"].status == "ok" and rows["y_minus_x"].estimate == pytest.approx(0)
    two = spark.createDataFrame([(1, "a", 1, 1, 1), (2, "b", 2, 0, 0)], df.schema)
    lost = bootstrap.cluster_bootstrap(two, {"x": "x"}, {"a": 0.5, "b": 0.5}, replicates=50).first()
    assert lost.estimate == 0.5 and lost.status == "withheld" and lost.lower_v is None and lost.undefined > 0


def test_positions(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    got = {r.cluster_id: r.ix for r in bootstrap.numbered(spark.createDataFrame([(i,) for i in ids + ids[:50]], "cluster_id long").repartition(9)).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
