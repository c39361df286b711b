import random

import pytest

from plumbline.operators import capture


def work(row):
    if row["kind"] == "poison":
        raise capture.UnitError("poisoned", f"unit {row['id']}")
    if row["kind"] == "divide":
        return {"n": 1 // 0}
    if row["kind"] == "type":
        return {"n": "many"}
    if row["kind"] == "extra":
        return {"other": 1}
    if row["kind"] == "flag":
        return {"n": True}
    if row["kind"] == "deep":
        return work(row)
    if row["text"] is None:
        return {}
    return {"n": len(row["text"]), "text": row["text"].upper()}


def test_units_fail_alone(spark):
    rng = random.Random(1)
    kinds = ["good"] * 5 + ["poison", "divide", "type", "extra", "flag", "deep"]
    rows = [(i, rng.choice(kinds), None if i % 9 == 0 else "x" * (i % 5)) for i in range(400)] + [(None, "good", "null id"), (None, "poison", "")]
    df = spark.createDataFrame(rows, "id long, kind string, text string").repartition(3)
    good, bad = capture.two_outputs(capture.captured(df, "id", work, "n long, text string"))
    code = {"poison": "poisoned", "divide": "ZeroDivisionError", "type": "bad_result", "extra": "bad_result", "flag": "bad_result", "deep": "RecursionError"}
    assert sorted((str(r.id), r.code) for r in bad.collect()) == sorted((str(i), code[k]) for i, k, _ in rows if k in code)
    want = [(str(i), None if t is None else len(t), None if t is None else t.upper()) for i, k, t in rows if k == "good"]
    assert sorted(((str(r.id), r.n, r.text) for r in good.collect()), key=str) == sorted(want, key=str)
    assert {r.message for r in bad.where("id = 5 OR code = 'poisoned' AND id IS NULL").collect() if r.code == "poisoned"} >= {"unit None"}


def test_an_empty_table(spark):
    good, bad = capture.two_outputs(capture.captured(spark.createDataFrame([], "id long, kind string, text string"), "id", work, "n long"))
    assert (good.count(), bad.count(), good.columns) == (0, 0, ["id", "n"])


def test_what_ends_the_process_is_not_swallowed(spark):
    def leave(row):
        raise SystemExit(3)

    with pytest.raises(Exception, match="SystemExit|crashed|EOF|Python worker"):
        capture.captured(spark.range(1), "id", leave, "n long").collect()
