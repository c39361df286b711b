import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import quality_rules
from plumbline.llm.queries import op2_quality_rules

from .util import SMALL, awkward, same_rows, texts


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, seen, lines = Counter(windows), set(), 0
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_statistics_match_brute_force(spark, table):
    df = awkward(spark) if table == "awkward" else spark.read.parquet(f"{SMALL}/documents.parquet")
    got = quality_rules.assess(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same_rows([tuple(r) for r in got], [(i, *base(t)) for i, t in texts(df)])


def test_keep_good_agrees_with_assess_and_keeps_columns(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.assess(df).where("kept").collect()}
    assert quality_rules.keep_good(awkward(spark)).columns == awkward(spark).columns


def test_empty_table(spark):
    df = awkward(spark).limit(0)
    assert quality_rules.assess(df).count() == 0 and quality_rules.keep_good(df).count() == 0


def plain_em(rows):
    """EM over single rows of votes, in numpy: (posteriors, share of good)."""
    v = np.array(rows)
    bad, good = (v == -1).astype(float), (v == 1).astype(float)
    p = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    for _ in range(200):
        share = (p.sum() + 1) / (len(p) + 2)
        g, b = ((w @ bad + 1) / (w @ (bad + good) + 2) for w in (p, 1 - p))
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + bad @ np.log(g / b) + good @ np.log((1 - g) / (1 - b)))))
    return p, share


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_posteriors_and_verdicts_match_em_over_rows(spark, folder):
    rows = quality_rules.assess(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")).collect()
    passed = [r for r in rows if not r.base_failed]
    want, _ = plain_em([r.votes for r in passed])
    assert max(abs(r.posterior - p) for r, p in zip(passed, want, strict=True)) < 1e-3
    assert [r.kept for r in passed] == [bool(p >= 0.5) for p in want] and not any(r.kept for r in rows if r.base_failed)


def test_em_decides_which_votes_count(spark):
    """Three rules agree on one document in ten; a fourth votes bad at random, so its votes come to mean nothing."""
    n = len(quality_rules.RULES)
    pattern = lambda *bad: [-1 if k in bad else 1 for k in range(n)]
    rows = [(pattern(0, 1, 2), 90), (pattern(0, 1, 2, 3), 10), (pattern(), 810), (pattern(3), 90)]
    df = spark.createDataFrame(rows, "votes array<int>, n long")
    model = quality_rules.fit(df)
    assert max(model.bad[:3]) < -4 and abs(model.bad[3]) < 0.5 and model.share_good == pytest.approx(0.9, abs=0.02)
    kept = {tuple(r.votes): r.p for r in df.select("votes", model.posterior(quality_rules.F.col("votes")).alias("p")).collect()}
    assert kept[tuple(pattern(3))] > 0.9 and kept[tuple(pattern(0, 1, 2))] < 0.1


def test_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op2_quality_rules(spark, "/root/testdata/sf0.01").where("n_words >= 50").join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_posterior_beats_passing_every_rule(spark):
    """On labelled documents that pass the base filter; some verdicts differ, and they differ for the better."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    strict = [-1 not in r.votes for r in rows]
    right = lambda verdicts: sum(v == bool(r.quality) for v, r in zip(verdicts, rows, strict=True))
    assert strict != [r.kept for r in rows] and right([r.kept for r in rows]) > right(strict)
