"""JSON Schema (draft 2020-12) compiled to columns: records that break it become issue rows with the place and the keyword.

A schema turns into one expression over a VARIANT that yields all issues of a record at once. References are written out where they stand;
one that comes back to itself is put off: its value and place go into rows of the next pass, which ends with the deepest record.
Patterns are Java's, found anywhere in the text; lengths count code points. Numbers compare as doubles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.variants import elements, escaped, kind, let, members, number, text

from .components import written

#: Keywords that say nothing about validity.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}

_TYPE = "array<struct<path:string,keyword:string,ref:string,value:variant>>"
Check = Callable[[Column, Column], Column]


def _none() -> Column:
    return F.expr(f"cast(array() AS {_TYPE})")


def _issue(bad: Column, path: Column, keyword: str) -> Column:
    row = F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("variant").alias("value"))
    return F.when(bad, F.array(row)).otherwise(_none())


def _canonical(v: Column) -> Column:
    n = number(v)
    return F.when(n.isNotNull(), n.cast("string")).otherwise(F.to_json(v))


def _constant(value) -> Column:
    return _canonical(F.parse_json(F.lit(json.dumps(value))))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


class Schema:
    """A compiled schema. ``documents``: other schemas by name, for references like ``common.json#/$defs/x``."""

    def __init__(self, schema: dict | bool, documents: Mapping[str, dict] | None = None):
        self.documents = {"": schema, **(documents or {})}
        self.deferred: set[str] = set()
        self.check = self._check(schema, "", (), False)

    def _resolve(self, ref: str, base: str) -> tuple[str, str, dict | bool]:
        name, _, pointer = ref.partition("#")
        name = name.rpartition("/")[2] or base
        node = self.documents[name]
        for token in pointer.split("/")[1:]:
            token = token.replace("~1", "/").replace("~0", "~")
            node = node[int(token)] if isinstance(node, list) else node[token]
        return f"{name}#{pointer}", name, node

    def at(self, ref: str) -> Check:
        """The check of a reference that was put off."""
        _, name, node = self._resolve(ref, "")
        return self._check(node, name, (ref,), False)

    def _check(self, schema: dict | bool, base: str, above: tuple[str, ...], closed: bool) -> Check:
        """``above``: references being written out; ``closed``: whether the result is counted, so that nothing can be put off."""
        if schema is True or schema is False:
            return lambda v, path: _issue(F.lit(not schema), path, "false")
        unknown = schema.keys() - ANNOTATIONS - _KEYWORDS
        if unknown:
            raise ValueError(f"unknown keywords {sorted(unknown)}")

        def sub(s: dict | bool, counted: bool = closed) -> Check:
            return self._check(s, base, above, counted)

        def run(v: Column, path: Column) -> Column:
            parts = [*_scalar_parts(schema, v, path), *_array_parts(schema, sub, v, path), *_object_parts(schema, sub, v, path)]
            parts += [sub(s)(v, path) for s in schema.get("allOf", ())]
            passes = lambda s: F.size(sub(s, True)(v, path)) == 0
            if "anyOf" in schema:
                parts.append(_issue(~reduce(Column.__or__, map(passes, schema["anyOf"])), path, "anyOf"))
            if "oneOf" in schema:
                parts.append(_issue(sum((passes(s).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1, path, "oneOf"))
            if "not" in schema:
                parts.append(_issue(passes(schema["not"]), path, "not"))
            if "if" in schema:
                then, other = sub(schema.get("then", True)), sub(schema.get("else", True))
                parts.append(F.when(passes(schema["if"]), then(v, path)).otherwise(other(v, path)))
            if "$ref" in schema:
                ref, name, node = self._resolve(schema["$ref"], base)
                if ref not in above:
                    parts.append(self._check(node, name, (*above, ref), closed)(v, path))
                elif closed:
                    raise ValueError(f"{ref} comes back to itself inside a condition")
                else:
                    self.deferred.add(ref)
                    parts.append(F.array(F.struct(path.alias("path"), F.lit("$ref").alias("keyword"), F.lit(ref).alias("ref"), v.alias("value"))))
            return _all(parts)

        return run


def _scalar_parts(schema: dict, v: Column, path: Column) -> list[Column]:
    parts = []
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        types += ["integer"] if "number" in types else []
        parts.append(_issue(~kind(v).isin(types), path, "type"))
    if "enum" in schema:
        parts.append(_issue(~_canonical(v).isin([_constant(x) for x in schema["enum"]]) if schema["enum"] else F.lit(True), path, "enum"))
    if "const" in schema:
        parts.append(_issue(_canonical(v) != _constant(schema["const"]), path, "const"))
    limits = {"minimum": Column.__lt__, "maximum": Column.__gt__, "exclusiveMinimum": Column.__le__, "exclusiveMaximum": Column.__ge__}
    parts += [_issue(F.coalesce(beyond(number(v), F.lit(float(schema[k]))), F.lit(False)), path, k) for k, beyond in limits.items() if k in schema]
    if "multipleOf" in schema:
        n = number(v) / F.lit(float(schema["multipleOf"]))
        parts.append(_issue(F.coalesce(n != F.floor(n), F.lit(False)), path, "multipleOf"))
    for k, beyond in (("minLength", Column.__lt__), ("maxLength", Column.__gt__)):
        if k in schema:
            parts.append(_issue(F.coalesce(beyond(F.char_length(text(v)), F.lit(schema[k])), F.lit(False)), path, k))
    if "pattern" in schema:
        parts.append(_issue(F.coalesce(~text(v).rlike(schema["pattern"]), F.lit(False)), path, "pattern"))
    return parts


def _array_parts(schema: dict, sub: Callable[..., Check], v: Column, path: Column) -> list[Column]:
    if not schema.keys() & {"items", "prefixItems", "contains", "minItems", "maxItems", "uniqueItems"}:
        return []
    place = lambda i: F.concat(path, F.lit("/"), i.cast("string"))

    def of(es: Column) -> Column:
        parts = [_issue(beyond(F.size(es), F.lit(schema[k])), path, k) for k, beyond in (("minItems", Column.__lt__), ("maxItems", Column.__gt__)) if k in schema]
        if schema.get("uniqueItems"):
            parts.append(_issue(F.size(F.array_distinct(F.transform(es, _canonical))) < F.size(es), path, "uniqueItems"))
        first = schema.get("prefixItems", [])
        parts += [F.when(F.size(es) > k, sub(s)(F.get(es, F.lit(k)), F.concat(path, F.lit(f"/{k}")))).otherwise(_none()) for k, s in enumerate(first)]
        if "items" in schema:
            check = sub(schema["items"])
            parts.append(F.flatten(F.transform(es, lambda e, i: F.when(i >= len(first), check(e, place(i))).otherwise(_none()))))
        if "contains" in schema:
            check = sub(schema["contains"], True)
            parts.append(_issue(~F.exists(es, lambda e: F.size(check(e, path)) == 0), path, "contains"))
        return _all(parts)

    return [F.coalesce(let(elements(v), lambda es: F.when(es.isNotNull(), of(es))), _none())]


def _object_parts(schema: dict, sub: Callable[..., Check], v: Column, path: Column) -> list[Column]:
    if not schema.keys() & {"properties", "required", "additionalProperties", "patternProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired"}:
        return []
    named = lambda k: F.concat(path, F.lit("/"), escaped(k))
    own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})

    def matching(pattern: str, check: Check) -> Callable[[Column], Column]:
        return lambda e: F.when(e["key"].rlike(pattern), check(e["value"], named(e["key"]))).otherwise(_none())

    def of(m: Column) -> Column:
        has = lambda k: F.map_contains_key(m, k)
        parts = [_issue(beyond(F.size(m), F.lit(schema[k])), path, k) for k, beyond in (("minProperties", Column.__lt__), ("maxProperties", Column.__gt__)) if k in schema]
        parts += [_issue(~has(k), named(F.lit(k)), "required") for k in schema.get("required", ())]
        parts += [_issue(has(k) & ~has(n), named(F.lit(n)), "dependentRequired") for k, needs in schema.get("dependentRequired", {}).items() for n in needs]
        parts += [F.when(has(k), sub(s)(m[k], named(F.lit(k)))).otherwise(_none()) for k, s in own.items()]
        parts += [F.flatten(F.transform(F.map_entries(m), matching(p, sub(s)))) for p, s in patterns.items()]
        if "additionalProperties" in schema:
            rest, more = sub(schema["additionalProperties"]), schema["additionalProperties"]
            known = lambda k: reduce(Column.__or__, (k.rlike(p) for p in patterns), k.isin(list(own)) if own else F.lit(False))
            broken = lambda e: _issue(F.lit(True), named(e["key"]), "additionalProperties") if more is False else rest(e["value"], named(e["key"]))
            parts.append(F.flatten(F.transform(F.map_entries(m), lambda e: F.when(known(e["key"]), _none()).otherwise(broken(e)))))
        if "propertyNames" in schema:
            check = sub(schema["propertyNames"], True)
            parts.append(F.flatten(F.transform(F.map_keys(m), lambda k: _issue(F.size(check(k.cast("variant"), path)) > 0, named(k), "propertyNames"))))
        return _all(parts)

    return [F.coalesce(let(members(v), lambda m: F.when(m.isNotNull(), of(m))), _none())]


_KEYWORDS = set(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern items prefixItems contains minItems maxItems uniqueItems "
    "properties required additionalProperties patternProperties propertyNames minProperties maxProperties dependentRequired allOf anyOf oneOf not if then else $ref".split()
)


def schema_issues(records: DataFrame, schema: dict | bool, documents: Mapping[str, dict] | None = None, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """id, path (JSON Pointer of the value, or of the member that lacks) and keyword of everything that breaks the schema.

    Texts that are no JSON, or repeat a key, have the keyword ``unreadable``; null records give nothing.
    """
    compiled = Schema(schema, documents)
    given = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("text")).where("text IS NOT NULL").select("id", F.try_parse_json("text").alias("value"))
    bad = given.where("value IS NULL").select("id", F.lit("").alias("path"), F.lit("unreadable").alias("keyword"))
    rows = given.where("value IS NOT NULL").select("id", F.inline(compiled.check(F.col("value"), F.lit(""))))
    if not compiled.deferred:
        return bad.unionByName(rows.select("id", "path", "keyword"))
    found, rows, again = [bad], written(rows, "schema-issues"), _again(compiled)
    while True:
        found.append(rows.where("ref IS NULL").select("id", "path", "keyword"))
        left = rows.where("ref IS NOT NULL").select("id", F.col("path").alias("at"), F.col("ref").alias("of"), "value")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        rows = written(left.select("id", F.inline(again)), "schema-issues")


def _again(compiled: Schema) -> Column:
    """The checks of all references that were put off, by the name in ``of``; they may put off others."""
    while True:
        refs, of = sorted(compiled.deferred), None
        for ref in refs:
            hit, check = F.col("of") == ref, compiled.at(ref)(F.col("value"), F.col("at"))
            of = F.when(hit, check) if of is None else of.when(hit, check)
        if refs == sorted(compiled.deferred):
            return of
