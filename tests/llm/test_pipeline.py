"""Each stage on its own input against a brute-force version."""

import re
from collections import Counter

import corpus_pipeline as cp
import pyarrow.parquet as pq
import pytest

from plumbline.llm import quality_rules

from .test_decontamination import brute as leaks
from .test_minhash_dedup import brute as groups
from .test_packing import check as check_packing
from .test_spans import secret_base
from .util import AWKWARD, SMALL, texts


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept[-1], SMALL)
        assert i == len(cp.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    rows = [texts(k) for k in kept[:-1]]

    assert ids[1] == {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()} and len(ids[1]) < len(ids[0])
    assert ids[2] == {d for d, _, _, first in groups(rows[1], 5, 80) if first}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ids[3] == ids[2] - {d for d, _ in leaks(rows[2], items)}
    assert ids[4] == ids[3]
    before, after = dict(rows[3]), dict(rows[4])
    assert all(not secret_base(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not secret_base(t) and not re.search("[A-Za-z0-9+/_=-]{20}", t))
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())
    assert check_packing(rows[4], kept[5].collect()) < 0.05


def test_run_is_the_stages(spark):
    assert cp.run(spark, SMALL).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clashing(spark, rows):
    """Documents with columns that stages use names of for their own."""
    extra = "posterior double, base string, spans string, kept boolean, n_words int, component_id int, gone string, cut int, ends int"
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 0.5, "b", "s", True, 1, 2, "g", 3, 4) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


_good = {r["doc_id"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist() if r["quality"] == 1}
#: A text that people labelled as good.
LONG = max((r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist() if r["doc_id"] in _good and r["lang"] == "en" and not secret_base(r["text"])), key=len)[:4000]
ROWS = [*AWKWARD, (20, LONG), (20, LONG), (21, LONG), (None, LONG), (22, LONG + " token=abcdefgh12345678 tail"), (23, " ".join(["tail"] * 3) + LONG[::-1])]


@pytest.mark.parametrize("k", range(4))
def test_stages_stand_awkward_rows_and_clashing_columns(spark, k):
    """Nulls, blanks, very long texts, repeated rows and null ids: columns and rows stay as they are but for what a stage decides."""
    docs = clashing(spark, ROWS)
    out = cp.STAGES[k][1](spark, docs, SMALL)
    assert out.columns == docs.columns
    rows = out.collect()
    given = Counter((i, t) for i, t in ROWS)
    if k == 3:
        got = {r.doc_id: (r.text, r.n_chars) for r in rows if r.doc_id == 22}
        assert len(rows) == len(ROWS) and "[SECRET]" in got[22][0] and "12345678" not in got[22][0] and got[22][1] == len(got[22][0])
        assert Counter((r.doc_id, r.text) for r in rows if r.doc_id not in (11, 22)) == Counter((i, t) for i, t in ROWS if i not in (11, 22))
        return
    kept = Counter((r.doc_id, r.text) for r in rows)
    assert all(kept[x] <= n for x, n in given.items()) and sum(kept.values()) == len(rows) and set(kept) <= set(given)
    if k == 0:
        verdicts = {(r.doc_id, r.kept) for r in quality_rules.assess(docs).collect()}
        assert {(i, True) for i, _ in kept} | {(i, False) for i, _ in given - kept} == verdicts and (20, LONG) in kept
    elif k == 1:
        assert (20, LONG) in kept and (21, LONG) not in kept and (None, LONG) in kept and (2, None) in kept
    else:
        assert (20, LONG) in kept and (21, LONG) in kept


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    docs = clashing(spark, ROWS).limit(0)
    out = cp.STAGES[k][1](spark, docs, SMALL)
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_packing_takes_awkward_rows(spark):
    rows = cp.STAGES[4][1](spark, clashing(spark, ROWS), SMALL).collect()
    ids = Counter(i for i, _ in ROWS)
    whole = Counter(r.doc_id for r in rows if r.start + r.length == r.doc_tokens)
    assert whole == ids and all(r.length > 0 for r in rows)
