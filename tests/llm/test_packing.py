import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import op9_packing

from .util import SMALL, awkward, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows):
    plain = Tokenizer.from_file(PATH)
    want = {}
    for doc, text in docs:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        want.setdefault(doc, []).append(ids)
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for doc, ps in pieces.items():
        left = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in ps)
        for ids in want[doc]:
            at = 0
            while at < len(ids):
                one = next(p for p in left if p[0] == at and p[3] == len(ids))
                assert one[2] == zlib.crc32(np.array(ids[at : at + one[1]], "<u4").tobytes())
                left.remove(one)
                at += one[1]
        assert not left
    padding = total = 0
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / total


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert check(texts(docs), op9_packing(spark, SMALL).collect()) < 0.01


def test_awkward_documents(spark):
    df = awkward(spark)
    extra = spark.createDataFrame([(90, "a\x1cb <|endoftext|>x İstanbul O'Neil's re've éá 　wide 123abc ...!!"), (91, "ǅ Ω ß ﬁ")], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(extra)
    check(texts(df), packing.pack(df, PATH).collect())
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_words_forgotten_in_the_middle(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    words, plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three", "four one five, six two", "One é two"):
        assert words.ids_of([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = 16
        points = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 14)))]))
        fee = rng.choice([0.0, 1.0, 5.0], len(points))
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n
        best = [0.0] + [np.inf] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                n = int(points[j] - points[i])
                if n <= size:
                    power = n & (n - 1) == 0 and points[j] > points[-1] - size
                    best[j] = min(best[j], best[i] + (0 if power else size - n) + fee[j])
        cuts = packing.choose_cuts(points, fee, size)
        got, last = 0.0, 0
        for j in cuts:
            n = int(points[j] - points[last])
            power = n & (n - 1) == 0 and points[j] > points[-1] - size
            got += (0 if power else size - n) + fee[j]
            last = j
        assert cuts[-1] == len(points) - 1 and abs(got - best[-1]) < 1e-9
