"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over standardised statistics. Every task
adds up the normal equations of its labelled rows; Spark sums them entry by entry, and the driver
solves ``FEATURES + 1`` unknowns, a size that no corpus changes. Scores of rows left out of the fit
are counted in ``BINS`` bins; isotonic regression over the bins turns raw scores into
probabilities. Means and spreads of the statistics come from all documents.

Defined results: null and empty texts have zero statistics and still get a score; repeated rows are
scored row by row; labels of one id are averaged and null labels ignored; without any usable label
every score is 0.5; an empty table gives an empty result; other columns are ignored. Ids decide only
the fold of a labelled row (``crc32(id) mod 3``), never a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise

FEATURES, WIDTH, RIDGE, SEED = 128, 0.35, 1.0, 20240229
BINS = 2000
STATS = ("words", "chars", "symbols", "capitals", "digits", "stops", "shouts", "word_length", "unique_words", "repeated_lines", "lines", "letters", "longest_word", "repeated_pairs")
TABLE = "doc_id long, stats array<double>"


def statistics(text: str) -> list[float]:
    """One number per name in STATS."""
    words = text.split()
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = lambda x, of: x / of if of else 0.0
    raw = text.encode("utf-8", "replace")
    gone = lambda drop: len(raw) - len(raw.translate(None, drop))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0  # noqa: B905
    return [
        np.log1p(n),
        np.log1p(chars),
        share(gone(b"#*$%&|<>"), chars) ** 0.5,
        share(gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars) ** 0.5,
        share(gone(b"0123456789"), chars) ** 0.5,
        share(gone(b".,;:?"), n),
        share(gone(b"!"), n) ** 0.5,
        share(chars, n),
        share(len(set(words)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(len(lines)),
        share(gone(b"abcdefghijklmnopqrstuvwxyz"), len(raw)),
        np.log1p(max(map(len, words), default=0)),
        share(n - 1 - pairs, n - 1) if n > 1 else 0.0,
    ]


def _stats_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            rows = [statistics(t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


class Features:
    """Random Fourier features, with a constant, of standardised statistics."""

    def __init__(self, mean: list[float], spread: list[float]):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = np.array(mean), np.array(spread)
        self.turn = rng.normal(0, WIDTH, (len(STATS), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.phase), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def normal_equations(labelled: DataFrame, features: Features) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """By fold: Z'Z, Z'y and the number of rows of (fold, stats, y), summed by Spark over the tasks' sums."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            z = np.hstack([features(_matrix(batch.column(1))), y[:, None]])
            for f in np.unique(fold):
                part = z[fold == f]
                total[int(f)] = total.get(int(f), 0) + part.T @ part
        for f, gram in total.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f), pa.int64()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(gram[i, j])], ["fold", "i", "j", "v"])

    entries = labelled.select("fold", "stats", "y").mapInArrow(sums, "fold long, i long, j long, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    size = FEATURES + 2
    grams: dict[int, np.ndarray] = {}
    for r in entries.collect():
        gram = grams.setdefault(r["fold"], np.zeros((size, size)))
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return {f: (g[:-1, :-1], g[:-1, -1], g[-2, -2]) for f, g in grams.items()}


def solve(parts: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    gram, right = sum(p[0] for p in parts), sum(p[1] for p in parts)
    pull = RIDGE * np.eye(len(gram))
    pull[-1, -1] = 1e-9
    return np.linalg.solve(gram + pull, right)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means nearest to ``value`` under ``weight`` (all positive)."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def _scored(df: DataFrame, features: Features, weights: dict[int, np.ndarray], schema: str) -> DataFrame:
    """(passed columns..., raw): the raw score under the weights of the row's ``use``; stats is column 1, use is column 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, use = features(_matrix(batch.column(1))), batch.column(0).to_numpy()
            raw = np.zeros(len(z))
            for f, w in weights.items():
                raw[use == f] = z[use == f] @ w
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(raw)], [*batch.schema.names[2:], "raw"])

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``; labels of ``held_fold`` are never read."""
    table = materialise(id_and_text(docs, id_col, text_col).mapInArrow(_stats_of, TABLE), "quality-classifier")
    moments = table.agg(*(F.avg(F.get("stats", F.lit(k))).alias(f"m{k}") for k in range(len(STATS))), *(F.stddev_pop(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(len(STATS)))).first()
    features = Features([moments[f"m{k}"] or 0.0 for k in range(len(STATS))], [max(moments[f"s{k}"] or 0.0, 1e-6) for k in range(len(STATS))])

    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(fold_of(F.col("doc_id")) != held_fold)
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    labelled = materialise(table.join(known, "doc_id").select(fold_of(F.col("doc_id")).alias("fold"), "stats", "y"), "quality-labelled")
    sums = normal_equations(labelled, features)
    calibrate = lambda raw: np.full(len(raw), 0.5)
    weights = np.zeros(FEATURES + 1)
    if sums:
        weights = solve(list(sums.values()))
        others = {f: solve([s for g, s in sums.items() if g != f] or list(sums.values())) for f in sums}
        left_out = _scored(labelled.select("fold", "stats", "y"), features, others, "y double, raw double")
        binned = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) / 2.0 * BINS))).cast("int")
        bins = sorted(tuple(r) for r in left_out.groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).collect())
        rising = isotonic(np.array([b[1] for b in bins], float), np.array([b[2] for b in bins]))
        at = np.array([b[3] for b in bins])
        # A little of the raw score keeps the order within a step.
        calibrate = lambda raw: np.clip(0.98 * np.interp(raw, at, rising) + 0.02 * np.clip(raw, 0, 1), 0, 1)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = calibrate(features(_matrix(batch.column(1))) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = table.mapInArrow(final, "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
