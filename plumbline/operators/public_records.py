"""Public records held against their contract: closed fields, attachments, evidence, candidates and reading packets, as issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import prompts
from plumbline.functions.variants import elements, members, text
from plumbline.sources.shared import MARKERS

from .components import written
from .json_schema import schema_issues

_NAME = {"type": "string", "minLength": 1}


def _closed(**properties: dict | bool) -> dict:
    return {"type": "object", "required": list(properties), "additionalProperties": False, "properties": properties}


_ATTACHMENT = _closed(asset_id=_NAME, path=_NAME, sha256={"type": "string", "pattern": "^[0-9a-f]{64}$"}, width={"type": "integer", "minimum": 1}, height={"type": "integer", "minimum": 1})
#: A record, and the JSON inside its prompt: evidence, output format and packet (fixed by the format).
RECORD = _closed(
    schema_version={"const": "public_v1"}, instance_id=_NAME, logical_probe_id=_NAME, task_id=_NAME, interface=_NAME, language=_NAME, split=_NAME, condition={"enum": ["raw", "gold"]},
    input=_closed(messages=_closed(system=_NAME, user=_NAME), attachments={"type": "array", "minItems": 1, "items": _ATTACHMENT}),
)
_BOX = {"type": "array", "minItems": 4, "maxItems": 4, "items": {"type": "integer", "minimum": 0, "maximum": 1000}}
LOCATOR = {
    "type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["visual", "text"]}},
    "if": {"properties": {"kind": {"const": "visual"}}}, "then": _closed(kind=True, image_id=_NAME, geometry=_closed(type={"const": "bbox"}, bbox_1000=_BOX)),
}
EVIDENCE = _closed(
    anchors={"type": "object", "minProperties": 1, "additionalProperties": LOCATOR},
    candidates={"type": "array", "minItems": 2, "items": _closed(alias={"type": "string"}, locators={"type": "array", "minItems": 1, "items": LOCATOR})},
)
PACKET = {"type": "array", "items": _closed(anchor_id={"type": "string"}, text={"type": "string", "pattern": "\\S"})}


def _repeated(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def record_issues(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, place and code of everything that breaks the contract of a public record.

    ``records``: id and record (JSON text); ``inventory``: path below the bundle and sha256. ``place`` is ``record``, ``evidence``,
    ``format`` or ``packet`` for codes that are keywords of a schema with its pointer behind a blank, and the codes of rules
    across fields are: ``sections`` (not all eight, once and in order), ``asset_twice``, ``path_unsafe``, ``hash_missing``, ``hash_differs``,
    ``alias_twice``, ``image_unattached``, ``anchor_unknown``, ``anchor_twice`` and ``packet_in_raw``. What can't be read further isn't judged further.
    """
    v = F.try_parse_json("record")
    given = members(members(v)["input"])
    rows = records.select("id", "record", text(members(v)["condition"]).alias("condition"), text(members(given["messages"])["user"]).alias("user"), elements(given["attachments"]).alias("files"))
    rows = rows.select("*", F.explode(F.array(prompts.sections(F.col("user")))).alias("parts"))
    part = lambda k: F.element_at("parts", F.lit(MARKERS[k]))
    packet = F.when(part(7) == "None.", F.lit("[]")).otherwise(part(7))
    rows = written(rows.select("id", "record", "condition", "user", "files", F.col("parts").isNotNull().alias("whole"), part(3).alias("evidence"), part(6).alias("format"), packet.alias("packet")), "public-records")

    found = []
    for place, schema in (("record", RECORD), ("evidence", EVIDENCE), ("format", {"type": "object"}), ("packet", PACKET)):
        broken = schema_issues(rows, schema, record_col=place)
        found.append(broken.select("id", F.concat_ws(" ", F.lit(place), F.when(F.col("path") != "", F.col("path"))).alias("place"), F.col("keyword").alias("code")))

    field = lambda name: lambda x: text(members(x)[name])
    ids = F.transform("files", field("asset_id"))
    evidence = members(F.try_parse_json("evidence"))
    anchors, candidates = members(evidence["anchors"]), F.coalesce(elements(evidence["candidates"]), F.expr("cast(array() AS array<variant>)"))
    shown = F.concat(F.coalesce(F.map_values(anchors), F.expr("cast(array() AS array<variant>)")), F.flatten(F.transform(candidates, lambda c: F.coalesce(elements(members(c)["locators"]), F.expr("cast(array() AS array<variant>)")))))
    images = F.filter(F.transform(shown, field("image_id")), lambda i: i.isNotNull())
    said = F.transform(elements(F.try_parse_json("packet")), field("anchor_id"))
    codes = {
        "sections": F.col("user").isNotNull() & ~F.col("whole"), "asset_twice": _repeated(ids), "alias_twice": _repeated(F.transform(candidates, field("alias"))),
        "image_unattached": F.size(F.array_except(images, ids)) > 0, "anchor_unknown": F.size(F.array_except(said, F.map_keys(anchors))) > 0, "anchor_twice": _repeated(said),
        "packet_in_raw": (F.col("condition") == "raw") & (F.size(said) > 0),
    }
    across = F.array_compact(F.array(*(F.when(bad, code) for code, bad in codes.items())))
    found.append(rows.select("id", F.lit("record").alias("place"), F.explode(across).alias("code")))

    files = rows.select("id", F.explode("files").alias("f")).select("id", field("path")(F.col("f")).alias("file"), field("sha256")(F.col("f")).alias("sha"))
    listed = files.withColumn("path", F.concat(F.lit("public/"), "file")).join(inventory.select("path", "sha256"), "path", "left")
    unsafe = F.col("file").rlike(r"^/|(^|/)\.\.(/|$)|\\")
    code = F.when(unsafe, "path_unsafe").when(F.col("sha256").isNull(), "hash_missing").when(F.col("sha256") != F.col("sha"), "hash_differs")
    found.append(listed.where("file IS NOT NULL").select("id", F.concat(F.lit("record "), "file").alias("place"), code.alias("code")).where("code IS NOT NULL"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def pairing_issues(records: DataFrame) -> DataFrame:
    """id and code where a raw and a gold record (instance_id, condition, record) don't belong together.

    Codes: ``item_twice``, ``gold_without_raw``, ``fields_differ`` (anything but condition, input), ``attachments_differ``,
    ``system_differs``, ``user_differs`` (outside the reading packet).
    """
    m = members(F.try_parse_json("record"))
    given = members(m["input"])
    messages = members(given["messages"])
    rows = records.select(
        F.col("instance_id").alias("id"), "condition", F.to_json(F.map_filter(m, lambda k, _: ~k.isin("condition", "input"))).alias("fields"), F.to_json(given["attachments"]).alias("attachments"),
        text(messages["system"]).alias("system"), F.regexp_replace(text(messages["user"]), r"(?s)\[" + MARKERS[7] + r"\]\n(?!.*\[" + MARKERS[7] + r"\]\n).*$", "").alias("user"),
    )
    parts = ("fields", "attachments", "system", "user")
    rows = rows.select("id", "condition", *(F.unhex(F.sha2(p, 256)).alias(p) for p in parts))  # digests, as texts would be shuffled whole
    one = rows.groupBy("id", "condition").agg(F.count(F.lit(1)).alias("n"), *(F.min(p).alias(p) for p in parts))
    gold = one.where("condition = 'gold'").select("id", *(F.col(p).alias(f"gold_{p}") for p in parts))
    # Merged by sort: the plan's guess of sizes, taken from the table that the records were made of, would broadcast them.
    met = gold.hint("merge").join(one.where("condition = 'raw'").select("id", F.lit(True).alias("there"), *parts), "id", "left")
    differ = [F.when(~F.col(p).eqNullSafe(F.col(f"gold_{p}")), f"{p}_differ{'s' if p in ('system', 'user') else ''}") for p in parts]
    codes = F.when(F.col("there").isNull(), F.array(F.lit("gold_without_raw"))).otherwise(F.array_compact(F.array(*differ)))
    return met.select("id", F.explode(codes).alias("code")).unionByName(one.where("n > 1").select("id", F.lit("item_twice").alias("code")))
