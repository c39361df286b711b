import zlib

import numpy as np

from plumbline.llm import quality_classifier as qc
from plumbline.llm.queries import op10_quality_classifier

from .util import awkward

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op10_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.93 and np.mean([(s >= 0.5) == y for y, s in held]) > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.select("doc_id", qc.F.when(qc.fold_of(qc.F.col("doc_id")) == 1, 1 - qc.F.col("quality")).otherwise(qc.F.col("quality")).alias("quality"))
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in qc.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, w = rng.random(6), rng.integers(1, 5, 6).astype(float)
        got = qc.isotonic(w, v)
        assert (np.diff(got) >= -1e-12).all()
        # min-max formula of isotonic regression
        mean = lambda i, j: (w[i : j + 1] @ v[i : j + 1]) / w[i : j + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(i, j) for j in range(k, 6)) for i in range(k + 1)) for k in range(6)]
        assert np.allclose(got, want)


def test_awkward_and_empty(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    rows = qc.score(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in qc.score(df, labels.limit(0)).collect()} == {0.5}
    assert qc.score(df.limit(0), labels).count() == 0


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    """Products of features against k = exp(-WIDTH^2 d^2 / 2), with the production number of features.

    A product is the mean of n terms 2 cos cos, whose variance is ((1 - k^2)^2 + 1) / 2. All pairs share their features, so one
    draw says little: over 40 seeds the mean square of the errors has to be what the variance says, and their mean nothing.
    """
    rng = np.random.default_rng(2)
    stats, n, seeds = rng.normal(0, 1, (60, len(qc.STATS))), qc.FEATURES, 40
    kernel = np.exp(-(qc.WIDTH**2) * ((stats[:, None] - stats[None]) ** 2).sum(2) / 2)
    expected, errors = np.sqrt((((1 - kernel**2) ** 2 + 1) / 2).mean()), []
    for seed in (qc.SEED, *range(seeds - 1)):
        monkeypatch.setattr(qc, "SEED", seed)
        z = qc.Features([0.0] * len(qc.STATS), [1.0] * len(qc.STATS))(stats)
        assert z.shape == (60, n + 1) and (z[:, -1] == 1).all()
        errors.append((z[:, :-1] @ z[:, :-1].T - kernel) * np.sqrt(n))
    errors = np.array(errors)
    assert abs(np.sqrt((errors**2).mean()) / expected - 1) < 0.07 and np.abs(errors).max() < 6
    assert np.sqrt((errors.mean(0) ** 2).mean() * seeds) < 1.5 * expected


def test_summed_equations_give_the_direct_fit(spark):
    """Weights from the tasks' sums by fold against least squares over all rows with the ridge as rows of its own."""
    rng = np.random.default_rng(3)
    stats, y, fold = rng.normal(0, 1, (500, len(qc.STATS))), rng.integers(0, 2, 500).astype(float), rng.integers(0, 3, 500)
    rows = [(int(f), [float(x) for x in s], float(v)) for f, s, v in zip(fold, stats, y, strict=True)]
    features = qc.Features([0.0] * len(qc.STATS), [1.0] * len(qc.STATS))
    sums = qc.normal_equations(spark.createDataFrame(rows, "fold long, stats array<double>, y double").repartition(7), features)
    pull = np.sqrt(np.diag([qc.RIDGE] * qc.FEATURES + [1e-9]))
    for use in ([0, 1, 2], [0, 2]):
        z, goal = features(stats[np.isin(fold, use)]), y[np.isin(fold, use)]
        direct = np.linalg.lstsq(np.vstack([z, pull]), np.concatenate([goal, np.zeros(len(pull))]), rcond=None)[0]
        assert np.allclose(qc.solve([sums[f] for f in use]), direct, atol=1e-8)
    assert sum(s[2] for s in sums.values()) == 500
