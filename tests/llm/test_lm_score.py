import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import lm_score as lm

from .util import awkward


def hashed(*texts):
    words, sizes = lm.words_in(pa.array(texts, pa.string()))
    return np.split(words, np.cumsum(sizes)[:-1])


def test_words_are_split_and_told_apart():
    """Against Python's own split; equal words have equal hashes wherever they stand, others have others."""
    rng = np.random.default_rng(9)
    letters = list("abAB\u00e9\u4e2d \t\n\x0b\x0c\r")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + [None, "", " ", "ab" * 200_000 + " ab", "x " * 100_000]
    names = {}
    for part in (texts, texts[::-1], texts[7:20]):
        for text, got in zip(part, hashed(*part), strict=True):
            words = (text or "").encode().lower().split()
            assert len(words) == len(got) and all(names.setdefault(w, h) == h for w, h in zip(words, got.tolist(), strict=True))
    column = lm.words_in(pa.array(["zero one", "ab Ab", None, "a"], pa.string()).slice(1))
    assert column[0].tolist() == [names[b"ab"], names[b"ab"], names[b"a"]] and column[1].tolist() == [2, 0, 1]
    assert len(set(names.values())) == len(names) and all(0 <= h < 1 << 63 for h in names.values())
    many = hashed(" ".join(f"{k}{i}" for i in range(300_000) for k in ("w", "")))[0]
    assert len(np.unique(many)) == 600_000
    spread = np.bincount(many % 4096, minlength=4096)
    assert abs(spread.std() / np.sqrt(spread.mean()) - 1) < 0.1  # as random numbers are


def slow(w, tokens):
    """One token at a time, from the definition."""
    total = 0.0
    for i, t in enumerate(tokens):
        near = [tokens[i + k] if 0 <= i + k < len(tokens) else lm.EDGE for k in range(-lm.REACH, lm.REACH + 1) if k]
        h = np.maximum(np.concatenate([w["embed"][n] for n in near]) @ w["mix"] + w["bias"], 0)
        high, middle, low = t // 256, t // 16 % 16, t % 16  # SIDE is 16, three digits
        for k, own in enumerate((high, middle, low)):
            logits = h @ w["out"][:, 16 * k : 16 * k + 16] + w["share"][16 * high + middle, 16 * k : 16 * k + 16]
            total += logits[own] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    return total


def some_weights():
    rng = np.random.default_rng(1)
    return {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in lm.fresh_weights().items()}


def test_sums_match_the_definition():
    w, rng = some_weights(), np.random.default_rng(2)
    texts = [rng.integers(0, lm.EDGE, n) for n in (0, 1, 7, 300, 0, 2)]
    assert np.allclose(lm.log_sums(w, texts), [slow(w, t) for t in texts], rtol=1e-4)


def test_scoring_mixes_a_class_once_for_all_its_positions():
    """What classes add to the hidden layer comes from a table; it is what the network makes of the window, and the same sums follow."""
    w, rng = some_weights(), np.random.default_rng(4)
    context, target = rng.integers(0, lm.EDGE + 1, (70, 2 * lm.REACH)), rng.integers(0, lm.EDGE, 70)
    parts = lm.mixed(w)
    assert [p.shape for p in parts] == [(lm.EDGE + 1, lm.HIDDEN)] * 2 * lm.REACH
    h = np.maximum(sum(p[context[:, k]] for k, p in enumerate(parts)), 0)
    _, want, logits = lm.logits_of(w, context, target)
    assert np.allclose(h, want, atol=1e-5)
    picked = logits.reshape(-1)[lm.places_of(target, 16)]
    assert all(picked[i, k] == logits[i, 16 * k + d] for i, t in enumerate(target) for k, d in enumerate((t // 256, t // 16 % 16, t % 16)))
    assert np.array_equal(lm.log_probability(w, context, target, parts), lm.log_probability(w, context, target))
    w.pop("mix")  # not used any more once the table is there
    assert np.isfinite(lm.log_sums(w, [target], parts)).all()


def test_gradients_match_differences():
    w, rng = {k: v.astype(np.float64) for k, v in some_weights().items()}, np.random.default_rng(3)
    context, target = rng.integers(0, lm.EDGE + 1, (5, 2 * lm.REACH)), rng.integers(0, lm.EDGE, 5)

    def loss(w):
        return -np.mean(lm.log_probability(w, context, target))

    new = {k: v.copy() for k, v in w.items()}
    lm.step(new, context, target, 1.0)
    assert (new[lm.FIXED] == w[lm.FIXED]).all()
    for name in w.keys() - {lm.FIXED}:
        slope = (w[name] - new[name]).reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            ends = []
            for d in (1e-5, -1e-5):
                other = {k: v.copy() for k, v in w.items()}
                other[name].reshape(-1)[i] += d
                ends.append(loss(other))
            assert abs((ends[0] - ends[1]) / 2e-5 - slope[i]) < 1e-4


def test_a_step_keeps_no_table_of_places_by_class():
    """Looking places up in a table of every class's numbers cost more than working them out, and twice the weights' memory."""
    w, rng = lm.fresh_weights(40), np.random.default_rng(6)
    context, target = rng.integers(0, 40**3 + 1, (64, 2 * lm.REACH)), rng.integers(0, 40**3, 64)
    tracemalloc.start()
    lm.step(w, context, target, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * w["embed"].size


def test_rare_words_are_counted_text_by_text():
    """Against a plain count; texts without words have empty lists."""
    rng = np.random.default_rng(8)
    words = np.sort(rng.integers(0, 1 << 62, 20))
    text, kind = np.sort(rng.choice([0, 2, 3, 6], 300)), rng.integers(0, 20, 300)
    got = lm._numbers(text, kind, words, 8).to_pylist()
    for i, entries in enumerate(got):
        assert {e["word"]: e["times"] for e in entries} == Counter(words[kind[text == i]].tolist()) and len(entries) == len(set(kind[text == i]))
    assert len(got) == 8 and lm._numbers(*np.zeros((3, 0), int), 2).to_pylist() == [[], []]


def test_large_logits_do_no_harm():
    """Rows far beyond what powers of e can hold, beside ordinary ones, which come to the same as alone."""
    rng = np.random.default_rng(5)
    logits = rng.normal(0, 3, (64, lm.DIGITS * lm.SIDE)).astype(np.float32)
    logits[5] *= 300
    logits[9] -= 500
    logits[11, :3] += 200
    want = logits.astype(np.float64).reshape(64, lm.DIGITS, -1)
    want = np.log(np.exp(want - want.max(2, keepdims=True)).sum(2)) + want.max(2)
    each, tops, sums = lm.exponentials(logits.copy(), lm.SIDE)
    assert np.isfinite(each).all() and np.allclose(tops + np.log(sums), want, rtol=1e-5, atol=1e-5)
    calm = np.delete(np.arange(64), [5, 9, 11])
    for a, b in zip((each, tops, sums), lm.exponentials(logits[np.repeat(calm[:1], 64)].copy(), lm.SIDE), strict=True):
        assert (a[calm[0]] == b[0]).all()


def test_untrained_biases_are_the_frequencies():
    """Without a context's say, a class has its share of the tokens, one more counted for each class."""
    tokens_of = np.random.default_rng(7).integers(0, 50, lm.EDGE)
    w = lm.fresh_weights() | {lm.FIXED: lm.biases(tokens_of)}
    target = np.arange(lm.EDGE)
    got = lm.log_probability(w, np.zeros((lm.EDGE, 2 * lm.REACH), int), target)
    assert np.allclose(np.exp(got), (tokens_of + 1) / (tokens_of.sum() + lm.EDGE), rtol=1e-4)


def test_trained_model_prefers_natural_order(spark):
    """Sentences of a small grammar against the same words shuffled."""
    rng = np.random.default_rng(4)
    parts = [[f"{kind}{i}" for i in range(5)] for kind in ("the", "noun", "verb", "adverb", "stop")]
    sentence = lambda n: [str(rng.choice(p)) for _ in range(n) for p in parts]
    corpus = [(i, " ".join(sentence(60))) for i in range(400)]
    weights = lm.train(spark.createDataFrame(corpus, "doc_id long, text string").repartition(2), rounds=2, stride=1)
    good = [sentence(10) for _ in range(30)]
    rows = [(i, " ".join(s)) for i, s in enumerate(good)] + [(100 + i, " ".join(rng.permutation(s))) for i, s in enumerate(good)]
    got = {r.doc_id: r.pll_per_token for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()}
    assert np.mean([got[i] > got[100 + i] for i in range(30)]) >= 0.95


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = lm.score(df).collect()
    assert len(rows) == df.count() and all(r.pll <= 0 for r in rows) and all(r.pll == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert lm.score(df.limit(0)).count() == 0


def test_production_setting_trains_every_position(spark):
    """Six-word sentences: every sixth position alone would train the first word of a sentence only."""
    rng = np.random.default_rng(6)
    parts = [[f"{kind}{i}" for i in range(3)] for kind in ("the", "adj", "noun", "verb", "adverb", "stop")]
    sentence = lambda n: [str(rng.choice(p)) for _ in range(n) for p in parts]
    corpus = [(i, " ".join(sentence(50))) for i in range(500)]
    weights = lm.train(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1))
    tokens = hashed(" ".join(sentence(20)))[0] % lm.EDGE
    p = np.exp(lm.log_probability(weights, lm.windows(tokens, np.arange(len(tokens))), tokens)).reshape(-1, 6)
    assert (np.median(p, 0) > 0.1).all()  # a third is the best, 1 / 4096 untrained


def test_words_of_one_class_are_told_apart(spark):
    """A frequent word and a rare one of the same 12 bits; one-word texts sum to a probability."""
    first = {}
    for i in range(10**5):
        word = f"w{i}"
        if (other := first.setdefault(int(hashed(word)[0][0]) % lm.EDGE, word)) != word:
            break
    docs = [(1, other), (2, word), (3, other), (4, other), (5, "else")]
    got = {r.doc_id: r.pll for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert np.isclose(got[1] - got[2], np.log(3)) and got[1] == got[3] == got[4]
    assert np.exp(got[1]) + np.exp(got[2]) + np.exp(got[5]) <= 1


def test_rare_words_by_shuffle_give_the_same(spark, monkeypatch):
    """All words by the broadcast table, or none."""
    df = spark.createDataFrame([(i, f"some words {i % 3} and word{i % 7} word{i}" if i % 5 else None) for i in range(40)], "doc_id long, text string")
    weights, got = lm.fresh_weights(), []
    for least in (0.0, 2.0):
        monkeypatch.setattr(lm, "FREQUENT", least)
        got.append({r.doc_id: r.pll for r in lm.score(df, weights).collect()})
    assert got[0].keys() == got[1].keys() and all(np.isclose(got[0][i], got[1][i]) for i in got[0])


def test_classes_grow_with_the_vocabulary():
    assert lm.side_of(10) == lm.SIDE < lm.side_of(10**6) < lm.side_of(10**7)


def test_weights_are_the_mean_over_tasks(spark):
    """Three tasks of unlike sizes against each trained alone, averaged by hand."""
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 100 * (1 + i // 3)))) for i in range(9)]
    table = lambda rows, tasks: spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string")
    counts = lm._counted(table(texts, 3))
    alone = [lm.train(table(texts[i : i + 3], 1), counts=counts) for i in (0, 3, 6)]
    for name, values in lm.train(table(texts, 3), counts=counts).items():
        assert np.allclose(values, sum(k * w[name] for k, w in enumerate(alone, 1)) / 6, atol=1e-6)
        assert name == lm.FIXED or not np.allclose(alone[0][name], alone[1][name], atol=1e-4)
