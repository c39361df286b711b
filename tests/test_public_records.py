"""Records that keep the contract, and each rule broken once."""

import copy
import json

from plumbline.operators import public_records
from plumbline.sources.shared import MARKERS

SHA = "ab" * 32
VISUAL = {"kind": "visual", "image_id": "i1", "geometry": {"type": "bbox", "bbox_1000": [0, 1, 2, 3]}}


def record(evidence=None, packet="None.", output='{"owner":"string"}', user=None, condition="gold", **more):
    evidence = evidence or {"anchors": {"A1": VISUAL, "A2": {"kind": "text", "at": 1}}, "candidates": [{"alias": "E1", "locators": [VISUAL]}, {"alias": "E2", "locators": [{"kind": "text"}]}]}
    body = ["statement", "question", "A or B", json.dumps(evidence), "legend", "local", output, packet if isinstance(packet, str) else json.dumps(packet)]
    user = user or "\n".join(f"[{m}]\n{b}" for m, b in zip(MARKERS, body, strict=True))
    files = [{"asset_id": "i1", "path": "images/1.png", "sha256": SHA, "width": 4, "height": 3}]
    return {"schema_version": "public_v1", "instance_id": "x", "logical_probe_id": "l", "task_id": "T", "interface": "f", "language": "en", "split": "test", "condition": condition, "input": {"messages": {"system": "s", "user": user}, "attachments": files}} | more


def changed(path, value, **how):
    out = copy.deepcopy(record(**how))
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def evidence(**more):
    base = {"anchors": {"A1": VISUAL}, "candidates": [{"alias": "E1", "locators": [VISUAL]}, {"alias": "E2", "locators": [{"kind": "text"}]}]}
    return base | more


FILE = ("input", "attachments", 0)
CASES = [
    (record(), set()), (record(packet=[{"anchor_id": "A1", "text": "2 kg"}]), set()), (record(condition="raw"), set()),
    (record(extra=1), {("record /extra", "additionalProperties")}), (changed(["split"], ""), {("record /split", "minLength")}), (changed(["condition"], "silver"), {("record /condition", "enum")}),
    (changed([*FILE, "width"], 0), {("record /input/attachments/0/width", "minimum")}), (changed([*FILE, "height"], 1.5), {("record /input/attachments/0/height", "type")}),
    (changed([*FILE, "path"], "../1.png"), {("record ../1.png", "path_unsafe")}), (changed([*FILE, "path"], "images/2.png"), {("record images/2.png", "hash_missing")}), (changed([*FILE, "sha256"], "cd" * 32), {("record images/1.png", "hash_differs")}),
    (changed(["input", "attachments"], []), {("record /input/attachments", "minItems"), ("record", "image_unattached")}), (changed(["input", "attachments"], record()["input"]["attachments"] * 2), {("record", "asset_twice")}),
    (record(user="no sections"), {("record", "sections")}), (record(output="text"), {("format", "unreadable")}), (record(output="[]"), {("format", "type")}),
    (record(evidence=evidence(anchors={})), {("evidence /anchors", "minProperties")}), (record(evidence=evidence(candidates=evidence()["candidates"][:1])), {("evidence /candidates", "minItems")}),
    (record(evidence=evidence(candidates=[{"alias": "E1", "locators": [VISUAL]}] * 2)), {("record", "alias_twice")}), (record(evidence=evidence(anchors={"A1": VISUAL | {"image_id": "i9"}})), {("record", "image_unattached")}),
    (record(evidence=evidence(anchors={"A1": VISUAL | {"geometry": {"type": "bbox", "bbox_1000": [0, 1, 2000]}}})), {("evidence /anchors/A1/geometry/bbox_1000", "minItems"), ("evidence /anchors/A1/geometry/bbox_1000/2", "maximum")}),
    (record(packet=[{"anchor_id": "A9", "text": "x"}]), {("record", "anchor_unknown")}), (record(packet=[{"anchor_id": "A1", "text": "x"}] * 2), {("record", "anchor_twice")}), (record(packet=[{"anchor_id": "A1", "text": " "}]), {("packet /0/text", "pattern")}),
    (record(packet=[{"anchor_id": "A1", "text": "x"}], condition="raw"), {("record", "packet_in_raw")}), (record(packet="{"), {("packet", "unreadable")}),
]


def test_every_rule(spark):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)] + [(900, "{"), (901, "[]")], "id int, record string")
    inventory = spark.createDataFrame([("public/images/1.png", SHA)], "path string, sha256 string")
    got = {}
    for r in public_records.record_issues(rows, inventory).collect():
        got.setdefault(r.id, set()).add((r.place, r.code))
    assert got.pop(900) == {("record", "unreadable")} and got.pop(901) == {("record", "type")}
    for i, (r, want) in enumerate(CASES):
        assert got.get(i, set()) == want, r


def test_pairs(spark):
    raw, gold = record(condition="raw"), record(packet=[{"anchor_id": "A1", "text": "x"}])
    pairs = {
        "good": [raw, gold], "alone": [gold], "raw only": [raw], "fields": [raw, gold | {"split": "dev"}], "system": [raw, changed(["input", "messages", "system"], "t")], "files": [raw, changed([*FILE, "width"], 9)],
        "user": [raw, record(output='{"x":1}')], "twice": [raw, raw, gold],
    }
    rows = spark.createDataFrame([(k, r["condition"], json.dumps(r)) for k, rs in pairs.items() for r in rs], "instance_id string, condition string, record string")
    got = sorted(tuple(r) for r in public_records.pairing_issues(rows).collect())
    assert got == [("alone", "gold_without_raw"), ("fields", "fields_differ"), ("files", "attachments_differ"), ("system", "system_differs"), ("twice", "item_twice"), ("user", "user_differs")]
