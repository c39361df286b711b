"""Schemas and key walks against plain Python, on random values."""

import json
import random
import re

import pytest

from plumbline.operators import json_schema, key_walk

KEYS = ("a", "b", "x~y", "p/q", "Secret", "n")


def some(rng, depth=3):
    pick = rng.randrange(9 if depth else 6)
    if pick < 6:
        return [None, True, rng.randint(-3, 9), rng.choice((0.5, -2.0, 7.25)), rng.choice(("", "ab", "Ünï", "abcd")), rng.randint(0, 3)][pick]
    if pick == 6:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: some(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(4))}


def types(v):
    if isinstance(v, bool):
        return {"boolean"}
    if isinstance(v, int | float):
        return {"number", "integer"} if v == int(v) else {"number"}
    return {{type(None): "null", str: "string", list: "array", dict: "object"}[type(v)]}


def same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (types(a) & types(b) >= {"number"} and a == b)


def esc(k):
    return k.replace("~", "~0").replace("/", "~1")


def plain(v, s, root, at=""):
    """All (path, keyword) of a value against a schema, keyword by keyword."""
    if isinstance(s, bool):
        return set() if s else {(at, "false")}
    out, number = set(), types(v) & {"number"}

    def put(bad, keyword, path=at):
        if bad:
            out.add((path, keyword))

    for k, x in s.items():
        if k == "type":
            put(not types(v) & set([x] if isinstance(x, str) else x), k)
        elif k == "enum":
            put(not any(same(v, y) for y in x), k)
        elif k == "const":
            put(not same(v, x), k)
        elif k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and number:
            put({"minimum": v < x, "maximum": v > x, "exclusiveMinimum": v <= x, "exclusiveMaximum": v >= x}[k], k)
        elif k == "multipleOf" and number:
            put((v / x) % 1 != 0, k)
        elif k in ("minLength", "maxLength") and isinstance(v, str):
            put(len(v) < x if k == "minLength" else len(v) > x, k)
        elif k == "pattern" and isinstance(v, str):
            put(not re.search(x, v), k)
        elif k in ("minItems", "maxItems") and isinstance(v, list):
            put(len(v) < x if k == "minItems" else len(v) > x, k)
        elif k == "uniqueItems" and isinstance(v, list):
            put(x and any(same(p, q) for i, p in enumerate(v) for q in v[:i]), k)
        elif k == "items" and isinstance(v, list):
            for i, e in enumerate(v):
                if i >= len(s.get("prefixItems", ())):
                    out |= plain(e, x, root, f"{at}/{i}")
        elif k == "prefixItems" and isinstance(v, list):
            for i, (e, y) in enumerate(zip(v, x, strict=False)):
                out |= plain(e, y, root, f"{at}/{i}")
        elif k == "contains" and isinstance(v, list):
            put(all(plain(e, x, root) for e in v), k)
        elif k in ("minProperties", "maxProperties") and isinstance(v, dict):
            put(len(v) < x if k == "minProperties" else len(v) > x, k)
        elif k == "required" and isinstance(v, dict):
            for n in x:
                put(n not in v, k, f"{at}/{esc(n)}")
        elif k == "dependentRequired" and isinstance(v, dict):
            for n, needs in x.items():
                for m in needs:
                    put(n in v and m not in v, k, f"{at}/{esc(m)}")
        elif k == "properties" and isinstance(v, dict):
            for n in x.keys() & v.keys():
                out |= plain(v[n], x[n], root, f"{at}/{esc(n)}")
        elif k == "patternProperties" and isinstance(v, dict):
            for p, y in x.items():
                for n in v:
                    if re.search(p, n):
                        out |= plain(v[n], y, root, f"{at}/{esc(n)}")
        elif k == "additionalProperties" and isinstance(v, dict):
            for n in v:
                if n not in s.get("properties", ()) and not any(re.search(p, n) for p in s.get("patternProperties", ())):
                    out |= {(f"{at}/{esc(n)}", k)} if x is False else plain(v[n], x, root, f"{at}/{esc(n)}")
        elif k == "propertyNames" and isinstance(v, dict):
            for n in v:
                put(plain(n, x, root), k, f"{at}/{esc(n)}")
        elif k == "allOf":
            for y in x:
                out |= plain(v, y, root, at)
        elif k in ("anyOf", "oneOf"):
            good = sum(not plain(v, y, root) for y in x)
            put(good == 0 if k == "anyOf" else good != 1, k)
        elif k == "not":
            put(not plain(v, x, root), k)
        elif k == "if":
            out |= plain(v, s.get("else" if plain(v, x, root) else "then", True), root, at)
        elif k == "$ref":
            out |= plain(v, root["$defs"][x.rpartition("/")[2]], root, at)
    return out


def schema(rng, depth=2):
    """A random schema of a few keywords."""
    sub = lambda: schema(rng, depth - 1)
    flat = {
        "type": lambda: rng.choice(["object", "array", "number", "integer", ["string", "null"], ["boolean", "object"]]), "enum": lambda: [some(rng, 1) for _ in range(3)], "const": lambda: some(rng, 1),
        "minimum": lambda: rng.randint(-1, 4), "maximum": lambda: rng.randint(2, 7), "exclusiveMinimum": lambda: 2, "exclusiveMaximum": lambda: 7.25, "multipleOf": lambda: rng.choice((0.5, 2)),
        "minLength": lambda: 1, "maxLength": lambda: 3, "pattern": lambda: rng.choice(("^a", "b", "ï$")), "minItems": lambda: 1, "maxItems": lambda: 2, "uniqueItems": lambda: True,
        "minProperties": lambda: 1, "maxProperties": lambda: 2, "required": lambda: rng.sample(KEYS, 2), "dependentRequired": lambda: {"a": ["x~y", "b"]}, "propertyNames": lambda: {"pattern": "^[a-z/]+$"},
    }
    deep = {
        "items": sub, "prefixItems": lambda: [sub(), sub()], "contains": sub, "properties": lambda: {k: sub() for k in rng.sample(KEYS, 3)}, "patternProperties": lambda: {"^[a-n]$": sub()},
        "additionalProperties": lambda: rng.choice((False, sub())), "allOf": lambda: [sub(), sub()], "anyOf": lambda: [sub(), sub()], "oneOf": lambda: [sub(), sub()], "not": sub, "$ref": lambda: "#/$defs/d",
    }
    if rng.random() < 0.1:
        return rng.random() < 0.8
    every = flat | (deep if depth else {})
    out = {k: every[k]() for k in rng.sample(sorted(every), 3)}
    if depth and rng.random() < 0.3:
        out |= {"if": sub(), "then": sub(), "else": sub()}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_schemas(spark, seed):
    rng = random.Random(seed)
    values = [some(rng) for _ in range(150)]
    root = {"$defs": {"d": schema(rng, 0)}, "allOf": [schema(rng) for _ in range(4)]}
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, record string")
    got = {}
    for r in json_schema.schema_issues(rows, root).collect():
        got.setdefault(r["id"], set()).add((r["path"], r["keyword"]))
    for i, v in enumerate(values):
        assert got.get(i, set()) == plain(v, root, root), (v, root)


def test_references_that_come_back(spark):
    """A tree of any depth; two definitions that name each other; another document."""
    root = {"$ref": "#/$defs/node", "$defs": {
        "node": {"type": "object", "required": ["n"], "properties": {"n": {"$ref": "common.json#/$defs/count"}, "a": {"$ref": "#/$defs/list"}}},
        "list": {"type": "array", "items": {"$ref": "#/$defs/node"}},
    }}
    common = {"$defs": {"count": {"type": "integer", "minimum": 0}}}
    value = {"n": -1}
    for k in range(6):
        value = {"n": k, "a": [value, {"a": k}, {"n": 1, "a": []}]}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, '{"n":0}'), (3, '{"n":0,"n":1}'), (4, None)], "id int, record string")
    got = {(r.id, r.path, r.keyword) for r in json_schema.schema_issues(rows, root, {"common.json": common}).collect()}
    deep = "/a/0"
    want = {(3, "", "unreadable"), (1, deep * 6 + "/n", "minimum")}
    for k in range(6):
        want |= {(1, deep * k + "/a/1/n", "required"), (1, deep * k + "/a/1/a", "type")}
    assert got == want


def test_what_cannot_be_compiled_is_refused():
    with pytest.raises(ValueError, match="unknown"):
        json_schema.Schema({"typ": "object"})
    with pytest.raises(ValueError, match="itself"):
        loop = json_schema.Schema({"$ref": "#/$defs/a", "$defs": {"a": {"not": {"$ref": "#/$defs/a"}}}})
        loop.check(json_schema.F.lit(1), json_schema.F.lit(""))


def paths(v, at=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield f"{at}/{esc(k)}", k
            yield from paths(x, f"{at}/{esc(k)}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from paths(x, f"{at}/{i}")


def test_walks_of_random_values(spark):
    rng = random.Random(9)
    values = [some(rng, 5) for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{"), (901, None)], "id int, record string")
    got = sorted((r.id, r.path, r.key) for r in key_walk.key_walk(rows).where("key IS NOT NULL").collect())
    assert got == sorted((i, *x) for i, v in enumerate(values) for x in paths(v))
    bad = {(r.id, r.path, r.key) for r in key_walk.prohibited_keys(rows, ("SECRET", "p/Q")).collect()}
    assert bad == {(i, *x) for i, v in enumerate(values) for x in paths(v) if x[1].lower() in ("secret", "p/q")} | {(900, "", None)}
    assert key_walk.key_walk(rows.where("false")).count() == 0
