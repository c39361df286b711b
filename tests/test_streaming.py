import random

import pytest
from pyspark.errors import StreamingQueryException

from plumbline.sources import tables
from plumbline.streaming import journal

SF = "/root/testdata/sf0.001"


class Killed(Exception):
    pass


def killed_at(sink, number, after):
    """A sink that dies once in batch ``number``, before or after it has written."""
    left = [1]

    def run(batch, n):
        if n == number and left and not after:
            left.pop()
            raise Killed
        sink(batch, n)
        if n == number and left and after:
            left.pop()
            raise Killed

    return run


@pytest.mark.parametrize("after", [False, True])
def test_a_killed_fold_ends_as_the_batch_fold(spark, tmp_path, after):
    batch = tables.attempts(spark, SF)
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: journal.fold(journal.events_stream(spark, str(tmp_path / "in"), batch.schema))
    sink = killed_at(journal.numbered_sink(str(tmp_path / "out")), 1, after)
    with pytest.raises(StreamingQueryException):
        journal.run_to_end(source(), sink, "update", str(tmp_path / "ckpt"))
    journal.run_to_end(source(), sink, "update", str(tmp_path / "ckpt"))
    from plumbline import catalog

    got = journal.latest(spark, str(tmp_path / "out"), journal.OUT, "request_id").where("attempt_count > 0")
    want = catalog.queries()["w07_journal_fold"](spark, SF)
    rows = lambda df: {(r.request_id, r.status, r.reason, r.attempt_count) for r in df.collect()}
    assert rows(got) == rows(want) and len({r[2] for r in rows(want)}) > 2


def test_first_submission_wins(spark, tmp_path):
    """Attempts go in by age over many triggers; later ones of a request are up to months apart from the first."""
    batch = tables.attempts(spark, SF).withColumn("ts", tables.F.expr("timestampadd(DAY, attempt * 40, ts)"))
    batch.repartition(5, "attempt").write.parquet(str(tmp_path / "in"))
    stream = journal.first_submissions(journal.events_stream(spark, str(tmp_path / "in"), batch.schema), "request_id")
    seen = []
    journal.run_to_end(stream, lambda df, _: seen.extend(r.request_id for r in df.collect()), "append", str(tmp_path / "ckpt"))
    assert len(seen) == len(set(seen)) == batch.select("request_id").distinct().count()


def test_first_answers_are_never_changed(spark, tmp_path):
    """Three deliveries, the second repeated after a kill; a smaller number that comes later changes nothing."""
    rng = random.Random(3)
    want, given = {}, [[(rng.randrange(30), rng.randrange(1000)) for _ in range(40)] for _ in range(3)]
    for rows in given:
        new = {}
        for task, seq in rows:
            if task not in want:
                new[task] = min(seq, new.get(task, seq))
        want |= new
    schema, out = "task long, seq long", str(tmp_path / "out")
    stream = lambda: journal.first_in_order(journal.events_stream(spark, str(tmp_path / "in"), schema), "task", "seq")
    sink = killed_at(journal.numbered_sink(out), 1, True)
    for k, rows in enumerate(given):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:
            with pytest.raises(StreamingQueryException):
                journal.run_to_end(stream(), sink, "append", str(tmp_path / "ckpt"))
        journal.run_to_end(stream(), sink, "append", str(tmp_path / "ckpt"))
    assert {r.task: r.seq for r in journal.latest(spark, out, schema, "task").collect()} == want
    assert spark.read.parquet(out).count() == len(want)


def test_the_fold_runs_no_python_per_request(spark):
    """A call per request cost more than all else; equal attempts end the same in any order."""
    rows = [(1, 0, "started"), (1, 1, "completed"), (2, 0, "retryable"), (2, 0, "started"), (3, 3, "completed"), (4, 1, "nonretryable"), (4, 2, "completed")]
    df = spark.createDataFrame(rows, "request_id long, attempt int, kind string")
    folded = journal.fold(df)
    assert "Python" not in folded._jdf.queryExecution().toString() and "Pandas" not in folded._jdf.queryExecution().toString()
    want = {(1, "completed", None, 2), (2, "infrastructure_missing", "interrupted_request_unknown_response", 2), (3, "infrastructure_missing", "retries_exhausted", 0), (4, "infrastructure_missing", "final_error", 2)}
    assert {tuple(r) for r in folded.collect()} == want


def test_first_answers_need_no_python_call_per_key(spark, tmp_path, monkeypatch):
    """A task takes its rows by Arrow batches, however often it must keep the firsts only; null keys and orders, ties and columns beside them."""
    monkeypatch.setattr(journal, "HELD", 3)
    schema = "place long, o int, text string, more array<int>"
    rows = [(k % 7 or None, None if k % 5 == 0 else k * 13 % 11, f"t{k * 29 % 31}", [k]) for k in range(60)] + [(9, None, "b", [1]), (9, None, "a", [2])]
    for k, part in enumerate((rows, [(4, -1, "late", []), (8, 3, "new", [])])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = journal.first_in_order(journal.events_stream(spark, str(tmp_path / "in"), schema), "place", "o")
        assert "FlatMapGroupsInPandasWithState" not in stream._jdf.queryExecution().logical().toString()
        journal.run_to_end(stream, journal.numbered_sink(str(tmp_path / "out")), "append", str(tmp_path / "ckpt"))
    want = {}
    for r in rows + [(8, 3, "new", [])]:
        rank = lambda x: (x[1] is None, x[1] or 0, x[2])
        if r[0] not in want or rank(r) < rank(want[r[0]]):
            want[r[0]] = r
    got = [tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / "batch=*")).collect()]
    assert len(got) == len(want) and {r[0]: r for r in got} == want
