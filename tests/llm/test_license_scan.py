import re

from plumbline.llm import license_scan as ls
from plumbline.llm.queries import op5_license_scan

from .util import awkward, same_rows, texts


def brute(docs, percent=ls.PERCENT):
    sets = [set(ls.template_bigrams(t)) for _, t in ls.TEMPLATES]
    out = []
    for doc, text in docs:
        lines = text.split("\n")
        for unit, part in [(0, text), *(enumerate(lines, 1) if len(lines) > 1 else [])]:
            own = set(ls.template_bigrams(part))
            scored = max((2 * len(own & t) / (len(own) + len(t)), -k) for k, t in enumerate(sets)) if own else (0, 0)
            if scored[0] * 100 >= percent:
                out.append((doc, "line" if unit else "text", unit, ls.TEMPLATES[-scored[1]][0], -scored[1], round(scored[0], 9), len(own)))
        words = re.findall("[a-z0-9]+", text.lower())
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905
        for k, (name, template) in enumerate(ls.TEMPLATES):
            width, best = len(ls.template_words(template)) - 1, (0, 0, 0)
            for i, p in enumerate(pairs):
                if p in sets[k]:
                    own = set(pairs[i : i + width])
                    best = max(best, (2 * len(own & sets[k]) / (len(own) + len(sets[k])), -i, len(own)))
            if best[0] * 100 >= percent:
                out.append((doc, "window", -best[1], name, k, round(best[0], 9), best[2]))
    return out


def run(df):
    return [tuple(r) for r in ls.scan(df).collect()]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(texts(docs))
    assert len(want) > 20
    same_rows([tuple(r) for r in op5_license_scan(spark, "/root/testdata/sf0.01").collect()], want)


def test_templates_and_near_templates(spark):
    docs = []
    for k, (_, t) in enumerate(ls.TEMPLATES):
        docs += [(k, t), (100 + k, f"intro line\n{t.upper()}\nmore"), (200 + k, re.sub(r"\b(the|of)\b", "a", t)), (300 + k, " ".join(t.split()[: len(t.split()) // 2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same_rows(run(df), brute(docs))
    found = {r[0] for r in run(df)}
    assert all(k in found and 100 + k in found for k in range(len(ls.TEMPLATES)))


def test_wrapped_and_embedded_licences(spark):
    """Wrapped at nine words, inside a longer line, joined by underscores, with edits; surrounded by other text."""
    filler = " ".join(f"filler{i % 37}" for i in range(400))
    docs = []
    for k, (_, t) in enumerate(ls.TEMPLATES):
        words = t.split()
        wrapped = "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        docs += [(k, f"{filler}\n * {wrapped}\n{filler}"), (100 + k, f"{filler} {t} {filler}"), (200 + k, f"{filler} {'_'.join(words)} {filler}")]
    docs.append((300, "Released_under_the_MIT_License"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = run(df)
    same_rows(got, brute(docs))
    found = {(r[0], r[4]) for r in got if r[1] == "window"}
    assert all({(k, k), (100 + k, k), (200 + k, k)} <= found for k in range(len(ls.TEMPLATES))) and (300, 0) in found


def test_awkward_and_empty(spark):
    df = awkward(spark)
    same_rows(run(df), brute(texts(df)))
    assert run(df.limit(0)) == []
