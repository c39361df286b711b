"""Whitened embeddings against a construction with exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening
from plumbline.llm.queries import op13_embedding_whitening

from .util import SMALL


def expected(rows, most=8):
    """Integer points, exact covariance numerators, then numpy's eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = [[n * v - t for v, t in zip(row, s, strict=True)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(len(s))] for i in range(len(s))])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    w = np.array(centred) / n @ vectors / np.sqrt(values)
    return [i for i, _ in rows], [sum(d * d for d in r) for r in centred], w, values / np.trace(cov)


def compare(got, want):
    ids, deviations, w, explained = want
    m = w.shape[1]
    assert len(got) == len(ids) * m
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == len(ids) and r["identity_error"] <= 1e-9 and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    for c in range(m):
        own = np.array([by[i, c + 1][0]["whitened"] for i in ids])
        assert min(np.abs(own - w[:, c]).max(), np.abs(own + w[:, c]).max()) < 1e-6
    assert all(by[i, 1][0]["deviation"] == d for i, d in zip(ids, deviations, strict=True))


def test_query_over_its_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compare(op13_embedding_whitening(spark, SMALL).collect(), expected(rows))


SCHEMA = "vec_id long, embedding array<float>, n int, w string, component int, x long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], SCHEMA).repartition(3)


def test_bad_vectors_go_and_few_dimensions_do(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * (1, 5, 0.2)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [0.0, -math.inf, 1.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    compare(got, expected(good))
    assert {r["component"] for r in got} == {1, 2, 3}


def test_repeated_rows_and_null_ids_count(spark):
    rows = [(2**60 + 1, [1.0, 0.0]), (2**60 + 1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [3.0, 3.5])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {5} and sum(r["vec_id"] is None for r in got) == 2
    assert sum(r["vec_id"] == 2**60 + 1 for r in got) == 4
    assert sum(r["whitened"] ** 2 for r in got if r["component"] == 1) == pytest.approx(5)


def test_no_variance(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4):
        got = whitening.whiten(frame(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (0.0, 0.0, 0.0, 0) for r in got)
    flat = whitening.whiten(frame(spark, [(i, [float(i), 7.0]) for i in range(5)])).collect()
    assert all(r["whitened"] == 0.0 for r in flat if r["component"] == 2) and {r["identity_error"] < 1e-9 for r in flat} == {True}


def test_empty_table(spark):
    out = whitening.whiten(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_stay_exact(spark):
    """Integers beyond what a long product holds are added as whole numbers; a deviation beyond a long is null."""
    rows = [(i, [float(2**40 * i), float(i * i)]) for i in range(6)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert all(r["deviation"] is None for r in got) and all(r["identity_error"] < 1e-6 for r in got)
