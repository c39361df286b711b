import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import graph, minhash_dedup
from plumbline.llm.queries import op8_minhash_dedup

from .util import SMALL, awkward, same_rows, texts


def shingles(text, width):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset([tuple(words)] if 0 < len(words) < width else zip(*[words[i:] for i in range(width)], strict=False))


def brute(docs, width=3, percent=85):
    sets = [shingles(t, width) for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    group = {}
    for i, (d, _) in enumerate(docs):
        group.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in group.items()}
    return [(d, len(sets[i]), least[root(i)], d is not None and d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def test_documents_match_brute_force(spark):
    got = [tuple(r) for r in op8_minhash_dedup(spark, SMALL).collect()]
    same_rows(got, brute(texts(spark.read.parquet(f"{SMALL}/documents.parquet"))))


@pytest.mark.parametrize("block", [256, 12])
def test_chains_of_near_copies_match_brute_force(spark, monkeypatch, block):
    """One family with copies at all distances, some linked only by way of others, and blocks smaller than the family."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        docs.append((1000 - i, " ".join(copy)))
    docs += [(5, docs[0][1]), (6, docs[0][1].upper()), (7, docs[3][1] + "\n")]
    got = [tuple(r) for r in minhash_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    same_rows(got, brute(docs))


def test_awkward_and_empty(spark):
    df = awkward(spark)
    same_rows([tuple(r) for r in minhash_dedup.groups(df).collect()], brute(texts(df)))
    assert minhash_dedup.groups(df.limit(0)).count() == 0
    kept = minhash_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == df.count()


def test_large_classes_and_blank_rows_match_brute_force(spark, monkeypatch):
    """Classes of three copies and more go by the broadcast table, the others by the shuffle."""
    monkeypatch.setattr(minhash_dedup, "HOT_COPIES", 2)
    docs = [(i, f"copy of text number {i % 4} and so on for a while") for i in range(40)] + [(100, "alone here"), (101, ""), (102, None), (103, "Alone  here"), (None, "alone here")]
    got = [tuple(r) for r in minhash_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    same_rows(got, brute([(i, t or "") for i, t in docs]))


def test_one_id_with_two_texts(spark):
    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    docs = [(1, a), (1, b), (2, a), (3, b)]
    same_rows([tuple(r) for r in minhash_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()], brute(docs))


def test_keep_one(spark):
    words = [str(i) for i in range(200)]
    docs = [(3, " ".join(words)), (2, " ".join(words[:-2])), (9, "other text entirely here now")]
    assert {r.doc_id for r in minhash_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {2, 9}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(a + 1)) for a in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 140, (25, 2))]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_subkeys_reach_the_recall():
    for s in (0.8, 0.85):
        m = minhash_dedup.subkeys(s)
        assert 1 - (1 - (1 - s**2) ** m) ** 2 <= minhash_dedup.MISSED


def test_a_bucket_goes_on_after_its_least_member(spark):
    """Two alike classes that meet only in buckets whose least member, always another, is unlike both."""
    m, rng = 8, np.random.default_rng(1)
    draw = lambda: rng.integers(0, 2**62, 2 * m).tolist()
    x, y, rows = draw(), draw(), []
    y[0], y[m:] = x[0], x[m:]
    for j in range(m):
        stranger = draw()
        stranger[0], stranger[m + j] = x[0], x[m + j]
        rows.append((b"a%d" % j, stranger))
    rows += [(b"x", x), (b"y", y)]
    got = minhash_dedup._clusters(spark.createDataFrame(rows, "node binary, keys array<long>"), m).collect()
    assert {bytes(r.node) for r in got} == {b"x", b"y"} and len({bytes(r.label) for r in got}) == 1


def test_rejected_members_meet_the_accepted_and_each_other():
    """Rows 0 and 1 were accepted; 2 is like 1, 3 and 4 are like each other, 5 is like none."""
    m, keys = 4, np.arange(48).reshape(6, 8)
    keys[2, :2], keys[4, 2:5] = keys[1, :2], keys[3, 2:5]
    ids = [bytes([i]) for i in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 6), pa.array([True, True, *[False] * 4]), pa.array(ids, pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["bucket", "ok", "node", "keys"])
    got = {tuple(r.values()) for b in minhash_dedup._carry_on(m)([batch]) for r in b.to_pylist()}
    assert got == {(ids[2], ids[1]), (ids[4], ids[3])}
