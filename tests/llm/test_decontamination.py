import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import decontamination as dc
from plumbline.llm.queries import op4_decontamination

from .util import SMALL, awkward, texts


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def free_edit(item, words):
    """Least edit distance of the item to any span of the words, by the plain matrix."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, percent=80):
    """Every span, every item; texts that lack more words than edits allow can't match."""
    out = set()
    for doc, text in docs:
        words = dc.words_of(text)
        for item, passage in items:
            want = dc.words_of(passage)
            most = len(want) * (100 - percent) // 100
            if want and sum((Counter(want) & Counter(words)).values()) >= len(want) - most and free_edit(want, words) <= most:
                out.add((doc, item))
    return out


def test_nearest_span_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(400):
        item, words = rng.integers(0, 4, rng.integers(1, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 14)).tolist()
        d = free_edit(item, words)
        for most in (0, 1, 3, 9):
            found = dc.nearest(item, words, most)
            assert (found is None) == (d > most)
            if found:
                assert found[2] == d and edit(item, words[found[0] : found[0] + found[1]]) == d


def edited(rng, words, times, kinds, word):
    """So many edits of these kinds at different places: 0 substitutes, 1 deletes, 2 inserts."""
    out = []
    places = set(rng.sample(range(len(words)), times))
    for i, w in enumerate(words):
        out += [[word()], [], [w, word()]][rng.choice(kinds)] if i in places else [w]
    return out


@pytest.mark.parametrize("size", [15, 30, 59, 100, 250, 500])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (0, 1, 2)])
def test_recall_at_the_greatest_distance(size, kinds):
    rng = random.Random(size)
    word = lambda: "w" + str(rng.randrange(20000))
    items = [(i, " ".join(word() for _ in range(size))) for i in range(60 if size <= 100 else 20)]
    index = dc.Index(items)
    texts = [[word() for _ in range(60)] + edited(rng, p.split(), size // 5, kinds, word) + [word() for _ in range(60)] for _, p in items]
    distances = [free_edit(p.split(), t) for (_, p), t in zip(items, texts, strict=True)]
    assert max(distances) == size // 5 and sum(distances) >= 0.85 * len(items) * (size // 5)
    found = {(t, k) for t, k, *_ in index.find([index.encode(" ".join(t)) for t in texts])}
    assert len(found & {(k, k) for k in range(len(items))}) >= dc.RECALL * len(items)


def test_clean_text_and_foreign_alphabets_give_nothing():
    rng = random.Random(4)
    index = dc.Index([(1, "Größe über alles, Ωmega point here and there"), (2, " ".join(f"w{rng.randrange(3000)}" for _ in range(50)))])
    assert not index.find([index.encode(" ".join(f"w{rng.randrange(3000)}" for _ in range(20000)))])
    texts = ["x GRÖSSE größe ÜBER alles; ωmega point here and there", "größe über alles ωmega point here and there…", "Größe über alles"]
    assert [(t, i, d) for t, i, _, _, d in index.find([index.encode(x) for x in texts])] == [(0, 0, 0), (1, 0, 0)]


@pytest.mark.parametrize("awkward_docs", [False, True])
def test_tables_match_brute_force(spark, awkward_docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    if awkward_docs:
        df = awkward(spark)
        benchmark = spark.createDataFrame([(1, "x y z x y z x"), (2, None), (3, ""), (4, "one"), (4, "one two"), (None, "no id at all")], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in dc.matches(df, benchmark).collect()}
        assert got == {(5, 4), (6, 4), (7, 1), (None, None)}
        assert dc.matches(df, benchmark.limit(0)).count() == 0 and dc.matches(df.limit(0), benchmark).count() == 0
        assert dc.drop_contaminated(df, benchmark).columns == df.columns
    else:
        docs = [d for d in texts(spark.read.parquet(f"{SMALL}/documents.parquet")) if len(d[1]) < 3000]
        got = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, SMALL).collect()}
        want = brute(docs, [tuple(r) for r in benchmark.collect()])
        assert want and want <= got and {d for d, _ in got - want}.isdisjoint({d for d, _ in docs})


def test_blocks_of_items_give_the_same(spark):
    docs, benchmark = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(dc.matches(docs, benchmark, block_chars=3000)) == key(dc.matches(docs, benchmark))
