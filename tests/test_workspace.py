import json

import pytest
from pyspark.errors import AnalysisException

from plumbline.sources import workspace


def batch(pid, **more):
    return {s: {"problem_id": pid, "n": k} for k, s in enumerate(workspace.STAGES)} | more


def test_batches_are_split_whole_or_not_at_all(spark, tmp_path):
    given = {
        1: batch("a"), 2: batch("b", pass2={"problem_id": "c"}), 3: {s: v for s, v in batch("d").items() if s != "pass4"}, 4: batch("e", extra={}), 5: batch("f", pass1={"problem_id": 5}),
        6: batch("g", pass3={}), 7: batch("h"), 8: batch("h"), 9: batch(""), 10: batch("i", pass1=[1]), 11: batch("j/ü"),
    }
    texts = [(k, json.dumps(v)) for k, v in given.items()] + [(12, "{"), (13, "[]"), (14, None), (15, '{"pass1":{},"pass1":{}}')]
    good, bad = workspace.split_stages(spark.createDataFrame(texts, "id int, record string"))
    got = {}
    for r in bad.collect():
        got.setdefault(r.id, set()).add(r.code)
    assert got == {
        2: {"problem_ids_differ"}, 3: {"missing:pass4"}, 4: {"unknown:extra"}, 5: {"no_problem_id"}, 6: {"no_problem_id"}, 7: {"problem_twice"}, 8: {"problem_twice"},
        9: {"no_problem_id"}, 10: {"no_problem_id"}, 12: {"unreadable"}, 13: {"unreadable"}, 14: {"unreadable"}, 15: {"unreadable"},
    }
    root = str(tmp_path / "ws")
    workspace.write_workspace(good, root)
    with pytest.raises(AnalysisException):
        workspace.write_workspace(good, root)
    back = {(r.problem, r.stage): json.loads(r.record) for r in workspace.scan_workspace(spark, root).collect() if r.code is None}
    assert back == {(p, s): v for p in ("a", "j/ü") for s, v in batch(p).items()}


def test_folders_with_a_file_per_problem(spark, tmp_path):
    def put(stage, name, text):
        (tmp_path / stage).mkdir(exist_ok=True)
        (tmp_path / stage / f"{name}.json").write_text(text)

    for stage in workspace.STAGES:
        put(stage, "p1", json.dumps({"problem_id": "p1", "x": 1}, indent=2))
    put("pass1", "p2", '{"problem_id": "other"}')
    put("pass2", "p2", "{")
    put("pass3", "p2", '{"x": 1}')
    scan = workspace.scan_workspace(spark, str(tmp_path))
    codes = {(r.problem, r.stage): r.code for r in scan.collect()}
    assert codes == {("p1", s): None for s in workspace.STAGES} | {("p2", "pass1"): "id_conflict", ("p2", "pass2"): "unreadable", ("p2", "pass3"): "no_problem_id"}
    issues = workspace.workspace_issues(scan, {"pass1": {"required": ["y"]}, "pass4": {"properties": {"x": {"minimum": 2}}}})
    want = {("p2", s, "", c) for (p, s), c in codes.items() if c} | {("p2", "pass4", "", "stage_missing"), ("p1", "pass1", "/y", "schema:required"), ("p1", "pass4", "/x", "schema:minimum")}
    assert {tuple(r) for r in issues.collect()} == want
    rows = {(r.stage, r.code): (r.issues, r.problems) for r in workspace.summary(scan, issues).collect()}
    assert rows[None, None] == (6, 2) and rows["pass1", None] == (2, 2) and rows["pass4", "stage_missing"] == (1, 1) and rows["pass1", "records"] == (2, 2)


def test_a_stage_that_comes_twice(spark):
    row = lambda k: ("p", "pass1", "{}", f"f{k}", None)
    scan = spark.createDataFrame([row(1), row(2)], "problem string, stage string, record string, file string, code string")
    codes = sorted((r.stage, r.code) for r in workspace.workspace_issues(scan, {}).collect())
    assert codes == [("pass1", "stage_twice"), *((s, "stage_missing") for s in workspace.STAGES[1:])]
