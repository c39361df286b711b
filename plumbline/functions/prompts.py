"""Prompts in marked sections, their evidence, aliases and templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.sources.shared import MARKERS

LOCATOR = "struct<kind:string,ref:string>"
EVIDENCE = f"struct<anchors:map<string,{LOCATOR}>,candidates:array<struct<alias:string,locators:array<{LOCATOR}>>>>"


def sections(user: Column, markers=MARKERS) -> Column:
    """map<marker, text> of a prompt that has every marker on a line of its own, once and in order, the first at its start; else null."""
    heads = [f"(?m)^\\[{m}\\]\\n" for m in markers]
    at = [F.regexp_instr(user, F.lit(h)) for h in heads]
    once = F.forall(F.array(*(F.regexp_count(user, F.lit(h)) for h in heads)), lambda n: n == 1)
    ordered = at[0] == 1
    for a, b in zip(at, at[1:]):  # noqa: B905
        ordered = ordered & (a < b)
    ends = [*at[1:], F.length(user) + 1]
    bodies = [F.substring(user, a + len(m) + 3, e - a - len(m) - 3) for m, a, e in zip(markers, at, ends, strict=True)]
    return F.when(once & ordered, F.map_from_arrays(F.array(*map(F.lit, markers)), F.array(*(F.regexp_replace(b, "\\n\\z", "") for b in bodies))))


def image_ids(legend: Column) -> Column:
    """The original images that a legend names; null if it names none, an empty one or one twice."""
    ids = F.transform(F.split(F.regexp_extract(legend, "(?m)^Original image IDs: (.+)$", 1), ","), lambda x: F.trim(x))
    return F.when(F.forall(ids, lambda x: x != "") & (F.size(F.array_distinct(ids)) == F.size(ids)), ids)


def without_geometry(evidence: Column) -> Column:
    """Canonical evidence text without visual locators; visual anchors are marked as withheld."""
    e = F.from_json(evidence, EVIDENCE)
    withheld = F.struct(F.lit("withheld_visual_anchor").alias("kind"), F.lit(None).cast("string").alias("ref"))
    anchors = F.transform_values(F.map_from_entries(F.array_sort(F.map_entries(e["anchors"]))), lambda _, v: F.when(v["kind"] == "text", v).otherwise(withheld))
    candidates = F.transform(e["candidates"], lambda c: F.struct(c["alias"].alias("alias"), F.filter(c["locators"], lambda x: x["kind"] == "text").alias("locators")))
    return F.to_json(F.struct(anchors.alias("anchors"), candidates.alias("candidates")))


def shuffled(values: Column, *seed: Column) -> Column:
    """The array in the order of hashes of (seed, element); moved on by one if that is the order it came in."""
    key = lambda x: F.sha2(F.concat_ws(":", *seed, x.cast("string")), 256)
    out = F.transform(F.array_sort(F.transform(values, lambda x: F.struct(key(x).alias("k"), x.alias("x")))), lambda s: s["x"])
    turned = F.concat(F.slice(values, 2, F.size(values)), F.slice(values, 1, 1))
    return F.when((F.size(values) > 1) & (out == values), turned).otherwise(out)


def replace_aliases(text: Column, mapping: Column) -> Column:
    """All whole-word aliases replaced at once, longer ones first; so permutations don't chain."""
    longest = F.transform(F.array_sort(F.transform(F.map_keys(mapping), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: F.concat(F.lit("\\Q"), s["k"], F.lit("\\E")))
    pattern = F.concat(F.lit("(?<!\\w)(?:"), F.array_join(longest, "|"), F.lit(")(?!\\w)"))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    return F.when(F.size(mapping) > 0, F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(F.element_at(mapping, p["match"]), F.lit("")))), "")).otherwise(text)


def placeholders(template: Column) -> Column:
    """Distinct names in braces, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit("\\{([a-z_]+)\\}"), F.lit(1))))


def render(template: Column, values: Column) -> Column:
    """Names in braces replaced by the map's values; null if the map lacks one."""
    parts = F.arrays_zip(F.split(template, "\\{[a-z_]+\\}", -1).alias("gap"), F.regexp_extract_all(template, F.lit("\\{([a-z_]+)\\}"), F.lit(1)).alias("name"))
    filled = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(F.element_at(values, p["name"]), F.lit("")))), "")
    return F.when(F.size(F.array_except(placeholders(template), F.map_keys(values))) == 0, filled)


def locator_status(text: Column, first: Column, stop: Column, quote: Column) -> Column:
    """ok, offset_out_of_range or quote_mismatch of a text locator (0-based, end exclusive)."""
    inside = (first >= 0) & (first < stop) & (stop <= F.length(text))
    return F.when(~F.coalesce(inside, F.lit(False)), "offset_out_of_range").when(F.substring(text, first + 1, stop - first).eqNullSafe(quote), "ok").otherwise("quote_mismatch")
