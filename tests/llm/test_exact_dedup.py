"""Exact duplicates against a dictionary, and the merge against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import exact_dedup
from plumbline.llm.queries import op12_exact_dedup

from .util import AWKWARD, SMALL, awkward, same_rows, texts


def expected(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[text or ""].append(doc_id)
    out = []
    for text, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


def run(df):
    return [tuple(r) for r in exact_dedup.groups(df).collect()]


def test_query_over_its_table(spark):
    want = expected(texts(spark.read.parquet(f"{SMALL}/documents.parquet")))
    same_rows([tuple(r) for r in op12_exact_dedup(spark, SMALL).collect()], want)
    assert any(not r[3] for r in want)


@pytest.mark.parametrize("parts", [1, 2, 7, 16, 40])
def test_runs_of_many_partitions(spark, parts):
    """A text that fills a third of all partitions, pairs across partitions, and texts that occur once."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 1400}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    same_rows(run(df), expected(rows))


def test_awkward_rows_and_clashing_columns(spark):
    clash = awkward(spark).selectExpr("*", "1 AS digest", "2 AS part", "3 AS owner", "4 AS row", "5 AS n", "6 AS keep_id")
    same_rows(run(clash), expected(AWKWARD))
    nulls = [(None, None), (None, ""), (None, "x"), (None, "x"), (-5, "x"), (-5, "x"), (-(2**63), "y"), (None, "y")]
    same_rows(run(spark.createDataFrame(nulls, "doc_id long, text string").repartition(3)), expected(nulls))
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_equality_is_verified_and_not_left_to_the_digest():
    e = np.zeros(4, exact_dedup.ENTRY)
    e["d0"], e["has_id"], e["id"], e["n"] = 7, 1, [1, 2, 3, 4], 1
    e["bytes"], e["check"] = [10, 10, 11, 10], [5, 5, 5, 6]
    out = exact_dedup.merged(e)
    assert [(int(r["bytes"]), int(r["check"]), int(r["id"]), int(r["n"])) for r in out] == [(10, 5, 2, 2), (10, 6, 4, 1), (11, 5, 3, 1)]


def test_owners_end_with_the_digests_first_bits(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 4000 AS string) AS text").repartition(37)
    text = exact_dedup.F.col("text")
    table = exact_dedup.materialise(
        df.select(
            "doc_id", exact_dedup.F.unhex(exact_dedup.F.sha2(text, 256)).alias("digest"), exact_dedup.F.lit(1).cast("long").alias("bytes"), exact_dedup.F.lit(1).cast("long").alias("check"),
            exact_dedup.F.spark_partition_id().cast("long").alias("part"), exact_dedup.F.monotonically_increasing_id().alias("row"),
        ),
        "test",
    )
    rows = exact_dedup.runs(table).collect()
    assert len(rows) == 4000 and {r["n"] for r in rows} == {1, 2}
    assert all(r["owner"] == int.from_bytes(r["digest"][:8], "big") >> 58 for r in rows)


def test_blocks_of_a_long_run_come_in_order(monkeypatch):
    """Many blocks of several runs, merged a few at a time, give one sorted run."""
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    monkeypatch.setattr(exact_dedup, "WAITING", 5)
    rng, blocks, count = np.random.default_rng(1), [], defaultdict(int)
    for _ in range(9):
        run = np.zeros(200, exact_dedup.ENTRY)
        run["d0"], run["n"] = rng.integers(0, 500, 200, np.uint64), 1
        run = exact_dedup.merged(run)
        for d, n in zip(run["d0"], run["n"], strict=True):
            count[int(d)] += int(n)
        blocks += [(0, exact_dedup._digests(run[k : k + 1]).tobytes(), run[k : k + 8].tobytes()) for k in range(0, len(run), 8)]
    blocks.sort(key=lambda b: b[1])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks[k : k + 7], strict=True)], ["owner", "low", "entries"]) for k in range(0, len(blocks), 7)]
    out = np.concatenate([np.frombuffer(b, exact_dedup.ENTRY) for batch in exact_dedup._merge_round(0, 0)(iter(batches)) for b in batch.column("entries").to_pylist()])
    assert [(int(d), int(n)) for d, n in zip(out["d0"], out["n"], strict=True)] == sorted(count.items())
