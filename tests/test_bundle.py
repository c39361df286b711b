import json

import pytest
from pyspark.errors import AnalysisException

from plumbline.sources import bundle


def test_records_are_read_strictly(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"x":2}\n\n{"id":2,"id":3}\n[1]\n{"id":4} x\n')
    rows = bundle.read_records(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted(str(r.record) for r in rows) == ["None", "None", "None", '{"id":1,"x":2}']
    (tmp_path / "b.json").write_text(json.dumps({"data": {"rows": [{"id": 1}, {"id": 2}]}}))
    assert [json.loads(r.record)["id"] for r in bundle.read_records(spark, str(tmp_path / "b.json"), pointer="/data/rows").collect()] == [1, 2]


def test_pointers():
    assert bundle.json_path("") == "$" and bundle.json_path("/a~1b/0/c~0d") == "$['a/b'][0]['c~d']"
    with pytest.raises(ValueError):
        bundle.json_path("a")


def test_inventory_and_integrity(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a").write_text("one")
    (root / "sub" / "b").write_text("two")
    before = [tuple(r)[:2] for r in bundle.inventory(spark, str(root)).collect()]
    assert sorted(p for p, _ in before) == ["a", "sub/b"]
    (root / "a").write_text("changed")
    (root / "c").write_text("new")
    (root / "sub" / "b").unlink()
    expected = spark.createDataFrame(before, "path string, sha256 string")
    assert {tuple(r) for r in bundle.integrity_issues(bundle.inventory(spark, str(root)), expected).collect()} == {("a", "changed"), ("c", "unexpected"), ("sub/b", "missing")}


def test_closed_schema(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1,"c":{"Answer": 1}}'), (3, None)], "id int, record string")
    assert {tuple(r) for r in bundle.closed_schema_issues(df, ["a", "b"], "id").collect()} == {(2, "missing:b"), (2, "unexpected:c"), (3, "not_an_object")}


def test_publication_refuses_what_exists(spark, tmp_path):
    df = spark.range(3)
    bundle.publish(df, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        bundle.publish(df, str(tmp_path / "out"))
    assert bundle.duplicate_keys(df.union(df.where("id = 1")), "id").collect()[0].n == 2
