"""Contracts of records and releases: schemas, key walks, published folders, roots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import strict_json
from plumbline.operators import campaign, candidates, capture, json_schema, key_walk, public_records, revisions, roots
from plumbline.operators.components import shared_folder, written
from plumbline.sources import images, release, shared, tables, workspace

from .base import Plan

plan = Plan()


def add(name: str, relation: str, build: Callable[[DataFrame], DataFrame], duck: str | None = None) -> None:
    """A query over one relation of ``shared`` and, if there is one, its twin over the same."""
    plan.queries[name] = lambda spark, sf_dir: build(shared.relation(spark, sf_dir, relation))
    if duck:
        plan.oracles[name] = shared.duck(relation, duck)


# JSON: schemas and keys

#: The contract of ``settings``: closed objects, bounds, names, and models that may hold models.
SETTINGS = {
    "type": "object",
    "required": ["name", "segment", "nation", "models"],
    "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "pattern": "^Customer#[0-9]*[02468]$", "maxLength": 18},
        "segment": {"enum": ["FURNITURE", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"]},
        "nation": {"type": "integer", "maximum": 20, "not": {"const": 5}},
        "balance": {"type": "integer", "minimum": 0},
        "models": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/model"}},
    },
    "patternProperties": {"_hint$": {"minLength": 9}},
    "$defs": {
        "model": {
            "type": "object",
            "anyOf": [{"required": ["id"]}, {"required": ["limits"]}],
            "properties": {
                "id": {"type": "string", "pattern": "^m[0-9]$"},
                "limits": {"properties": {"tokens": {"exclusiveMaximum": 500, "minimum": 0}}, "additionalProperties": False},
                "inner": {"items": {"$ref": "#/$defs/model"}},
            },
            "propertyNames": {"pattern": "^[a-z]+$"},
        }
    },
}

_READABLE = "c_nationkey<>11"
add(
    "h41_schema_issues", "settings",
    lambda s: json_schema.schema_issues(s, SETTINGS),
    f"""SELECT id, '' AS path, 'unreadable' AS keyword FROM settings WHERE c_nationkey=11
  UNION ALL SELECT id, '/name', 'pattern' FROM settings WHERE {_READABLE} AND NOT regexp_matches(c_name, '[02468]$') UNION ALL SELECT id, '/name', 'maxLength' FROM settings WHERE {_READABLE} AND length(c_name)>18
  UNION ALL SELECT id, '/segment', 'enum' FROM settings WHERE {_READABLE} AND c_mktsegment='BUILDING' UNION ALL SELECT id, '/nation', 'maximum' FROM settings WHERE {_READABLE} AND c_nationkey>20
  UNION ALL SELECT id, '/nation', 'not' FROM settings WHERE c_nationkey=5 UNION ALL SELECT id, '/balance', 'minimum' FROM settings WHERE {_READABLE} AND c_acctbal<0
  UNION ALL SELECT id, '/extra', 'additionalProperties' FROM settings WHERE c_nationkey=7 UNION ALL SELECT id, '/password_hint', 'minLength' FROM settings WHERE c_nationkey%6=0 AND length('password')<9
  UNION ALL SELECT id, '/models/0/limits/API_Key', 'additionalProperties' FROM settings WHERE c_nationkey=3 UNION ALL SELECT id, '/models/0/limits/tokens', 'exclusiveMaximum' FROM settings WHERE {_READABLE} AND id%700>=500
  UNION ALL SELECT id, unnest(['/models/1/id', '/models/1/inner/0/limits/tokens', '/models/1/inner/1/Secret', '/models/1/inner/1/id']), unnest(['pattern', 'minimum', 'propertyNames', 'type']) FROM settings WHERE c_nationkey%4=1""",
)

#: Rows of DuckDB's own walk, with its paths as pointers; the last of a repeated key would win there, so those records are told apart first.
_TREE = """t AS (SELECT s.id, t.key, t.type, t.fullkey, replace(replace(regexp_replace(t.fullkey, '\\[(\\d+)\\]', '.\\1', 'g'), '$', ''), '.', '/') AS path FROM settings s, json_tree(s.record) t WHERE c_nationkey<>11)"""
add(
    "h48_key_walk", "settings", key_walk.key_walk,
    f"""WITH {_TREE} SELECT id, path, key, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind,
  CAST(length(path)-length(replace(path,'/','')) AS INT) AS depth FROM t WHERE path<>'' AND fullkey NOT LIKE '%]' UNION ALL SELECT id, '', NULL, 'unreadable', 0 FROM settings WHERE c_nationkey=11""",
)
add(
    "p23_credential_keys", "settings", key_walk.prohibited_keys,
    f"""WITH {_TREE} SELECT id, path, key FROM t WHERE lower(key) IN ('api_key','access_token','auth_token','authorization','password','secret') UNION ALL SELECT id, '', NULL FROM settings WHERE c_nationkey=11""",
)


# Releases and roots


def _place(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}"


def k04_staged_release(p: DataFrame) -> DataFrame:
    """Items of a release read back from its verified folder; whether a writer that failed first left anything, and a second one was refused."""
    spark, final = p.sparkSession, _place(p, "release")
    items = p.select(F.col("item").cast("string").alias("instance_id"), "user_text")
    left, refused = True, False
    try:
        with release.staged(spark, final) as stage:
            items.write.json(f"{stage}/public/items")
            raise InterruptedError
    except InterruptedError:
        left = release.exists(spark, final)
    with release.staged(spark, final) as stage:
        items.write.json(f"{stage}/public/items")
        p.where("fault < 7").select("item", "fault").write.parquet(f"{stage}/private/truth")
    try:
        with release.staged(spark, final):
            pass
    except release.PublishError:
        refused = True
    rows = spark.read.schema("instance_id string, user_text string").json(release.verified(spark, final) + "/public/items")
    return rows.select("instance_id", F.sha2("user_text", 256).alias("input_hash"), F.lit(left).alias("left_behind"), F.lit(refused).alias("refused"))


add("k04_staged_release", "prompts", k04_staged_release, "SELECT CAST(item AS VARCHAR) AS instance_id, sha256(user_text) AS input_hash, false AS left_behind, true AS refused FROM prompts")


def k03_atomic_replace(p: DataFrame) -> DataFrame:
    """The current version after two replacements; the first one's rows are still there for who reads them."""
    root = _place(p, "table")
    release.replace(p.where("fault < 7").select("item", F.lit("first").alias("version")), root)
    before = release.current(p.sparkSession, root)
    release.replace(p.select("item", F.lit("second").alias("version")), root)
    return release.current(p.sparkSession, root).unionByName(before).groupBy("version").agg(F.count(F.lit(1)).alias("rows"), F.min("item").alias("least"), F.max("item").alias("most"))


add(
    "k03_atomic_replace", "prompts", k03_atomic_replace,
    "SELECT 'second' AS version, count(*) AS rows, min(item) AS least, max(item) AS most FROM prompts UNION ALL SELECT 'first', count(*), min(item), max(item) FROM prompts WHERE fault<7",
)


def _stores(r: DataFrame) -> tuple[roots.Snapshot, roots.Snapshot]:
    leaves = r.select("id", "version", roots.record_digest(F.col("record"), ("seen",)).alias("digest"))
    before, after = (roots.snapshot(leaves.where(F.col("version") == v).select("id", "digest")) for v in ("before", "after"))
    return before, after


def h33_roots(r: DataFrame) -> DataFrame:
    """Root and number of records of both versions."""
    nodes = [s.nodes.where("depth = 0").select(F.lit(v).alias("version"), "digest", "n") for v, s in zip(("before", "after"), _stores(r), strict=True)]
    return nodes[0].unionByName(nodes[1])


_WORDS = ", ':', ".join(f"CAST(sum(('0x'||substr(w,{8 * i + 1},8))::BIGINT) AS BIGINT)" for i in range(8))
add(
    "h33_roots", "review_store", h33_roots,
    f"""WITH l AS (SELECT version, sha256('='||id) AS place, sha256(sha256(concat('{{"priority":"', o_orderpriority, '","refs":[', o_custkey, ',', o_custkey%7, '],"state":"', state, '"}}'))) AS w FROM review_store),
b AS (SELECT version, substr(place,1,2) AS p, sha256(concat({_WORDS}, ':', count(*))) AS d, count(*) AS n FROM l GROUP BY 1,2), c AS (SELECT version, substr(p,1,1) AS p, sha256(string_agg(substr(p,2,1)||d, '' ORDER BY p)) AS d, sum(n) AS n FROM b GROUP BY 1,2)
SELECT version, sha256(string_agg(p||d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY version""",
)
add(
    "h24_reverification", "review_store", lambda r: roots.changes(*_stores(r)),
    """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS code
FROM (SELECT * FROM review_store WHERE version='before') a FULL JOIN (SELECT * FROM review_store WHERE version='after') b ON a.id=b.id WHERE a.id IS NULL OR b.id IS NULL OR a.state<>b.state""",
)

# Images

_FAULTS = "CASE shape WHEN 1 THEN 'no_header_chunk' WHEN 4 THEN 'no_frame' WHEN 5 THEN 'segment_length' WHEN 6 THEN 'truncated_frame' WHEN 7 THEN 'marker' WHEN 8 THEN 'truncated_marker' WHEN 9 THEN 'unsupported' WHEN 10 THEN 'missing' END"
_FOUND = f"SELECT *, {_FAULTS} AS code, CASE WHEN shape=0 THEN 'image/png' WHEN shape IN (2,3) THEN 'image/jpeg' END AS mime FROM image_files"


def _images(files: DataFrame) -> DataFrame:
    return images.with_headers(files.select("path", F.unhex("hex").alias("content")))


add("s09_image_headers", "image_files", _images, f"SELECT path, mime, CASE WHEN code IS NULL THEN width END AS width, CASE WHEN code IS NULL THEN height END AS height, code FROM ({_FOUND}) x")
add(
    "h06_dimension_issues", "image_files",
    lambda f: images.dimension_issues(_images(f).where("code IS NULL OR code <> 'missing'"), f.select("path", F.col("want_mime").alias("mime"), F.col("want_width").alias("width"), F.col("want_height").alias("height"))),
    f"""SELECT * FROM (SELECT path, CASE WHEN code='missing' THEN 'missing' WHEN code IS NOT NULL THEN 'unreadable:'||code WHEN mime<>want_mime THEN 'mime' WHEN width<>want_width OR height<>want_height THEN 'dimensions' END AS code FROM ({_FOUND}) x) y WHERE code IS NOT NULL""",
)


# Workspaces

_BATCH_CODE = "CASE c_nationkey WHEN 2 THEN 'unreadable' WHEN 4 THEN 'problem_ids_differ' WHEN 9 THEN 'missing:pass4' WHEN 13 THEN 'unknown:pass9' WHEN 17 THEN 'no_problem_id' WHEN 18 THEN 'no_problem_id' END"
_STAGED = f"""w AS (SELECT id, 'p'||id AS problem, c_nationkey, c_mktsegment, c_name FROM batches WHERE {_BATCH_CODE} IS NULL),
st AS (SELECT problem, 'pass1' AS stage, concat('{{"nodes":[', c_nationkey, ',1],"problem_id":"', problem, '"}}') AS record FROM w UNION ALL SELECT problem, 'pass2', concat('{{"label":"', c_mktsegment, '","problem_id":"', problem, '"}}') FROM w
  UNION ALL SELECT problem, 'pass3', concat('{{"problem_id":"', problem, '"}}') FROM w UNION ALL SELECT problem, 'pass4', concat('{{"by":"', c_name, '","problem_id":"', problem, '"}}') FROM w)"""


def _workspace(batches: DataFrame) -> DataFrame:
    """The whole batches split, written by stage, and scanned."""
    good, _ = workspace.split_stages(batches)
    workspace.write_workspace(good, root := _place(batches, "workspace"))
    return workspace.scan_workspace(batches.sparkSession, root)


add("h59_split_issues", "batches", lambda b: workspace.split_stages(b)[1], f"SELECT id, {_BATCH_CODE} AS code FROM batches WHERE {_BATCH_CODE} IS NOT NULL")
add("s08_workspace_scan", "batches", lambda b: _workspace(b).select("problem", "stage", "record", "code"), f"WITH {_STAGED} SELECT problem, stage, record, CAST(NULL AS VARCHAR) AS code FROM st")

#: Contracts of the stages in ``batches``.
STAGE_SCHEMAS = {
    "pass1": {"properties": {"nodes": {"items": {"minimum": 1, "maximum": 20}, "uniqueItems": True}}},
    "pass2": {"required": ["label"], "properties": {"label": {"pattern": "^[A-M]"}}},
    "pass4": {"properties": {"by": {"pattern": "[13579]$"}}},
}


def h60_summary(batches: DataFrame) -> DataFrame:
    """All validators over all problems and stages, rolled up."""
    scan = _workspace(batches)
    return workspace.summary(scan, workspace.workspace_issues(scan, STAGE_SCHEMAS))


add(
    "h60_workspace_summary", "batches", h60_summary,
    f"""WITH {_STAGED}, i AS (SELECT problem, 'pass1' AS stage, 'schema:maximum' AS code FROM w WHERE c_nationkey>20 UNION ALL SELECT problem, 'pass1', 'schema:minimum' FROM w WHERE c_nationkey<1 UNION ALL SELECT problem, 'pass1', 'schema:uniqueItems' FROM w WHERE c_nationkey=1
  UNION ALL SELECT problem, 'pass2', 'schema:pattern' FROM w WHERE c_mktsegment>='N' UNION ALL SELECT problem, 'pass4', 'schema:pattern' FROM w WHERE right(c_name, 1) IN ('0','2','4','6','8'))
SELECT stage, code, count(*) AS issues, count(DISTINCT problem) AS problems FROM i GROUP BY ROLLUP (stage, code) UNION ALL SELECT stage, 'records', count(*), count(DISTINCT problem) FROM st GROUP BY stage""",
)

# Units that fail, versions, candidates


def _parse(row: dict) -> dict:
    """Owner and read of a strict answer; what is wrong with it is raised."""

    def once(pairs: list) -> dict:
        if len(dict(pairs)) < len(pairs):
            raise capture.UnitError("key_twice")
        return dict(pairs)

    value = json.loads(strict_json.unfenced(row["response"]), object_pairs_hook=once)
    if not isinstance(value, dict):
        raise capture.UnitError("no_object", type(value).__name__)
    return {"owner": value["owner"].strip(), "read": value.get("read")}


def h27_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that parse and error records of those that don't, from one pass over all."""
    good, bad = capture.two_outputs(capture.captured(tables.responses(spark, sf_dir).select("probe_id", "response"), "probe_id", _parse, "owner string, read string"))
    return good.withColumn("code", F.lit(None).cast("string")).unionByName(bad.select("probe_id", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("read"), "code"))


plan.add(
    "h27_error_records", h27_errors, "responses",
    """WITH b AS (SELECT probe_id, CASE WHEN response LIKE '```%' THEN regexp_extract(response, '```json\n(.*)\n```', 1) ELSE response END AS t FROM {responses}),
c AS (SELECT probe_id, t, CASE WHEN NOT json_valid(t) THEN 'JSONDecodeError' WHEN json_type(t)<>'OBJECT' THEN 'no_object' WHEN len(json_keys(t))>len(list_distinct(json_keys(t))) THEN 'key_twice' WHEN json_extract_string(t, '$.owner') IS NULL THEN 'KeyError' END AS code FROM b)
SELECT probe_id, CASE WHEN code IS NULL THEN trim(json_extract_string(t, '$.owner')) END AS owner, CASE WHEN code IS NULL THEN json_extract_string(t, '$.read') END AS read, code FROM c""",
)

_PARENTS = "CASE WHEN rn=1 THEN (CASE WHEN l_quantity>46 THEN {a}2{z} WHEN l_quantity>42 THEN {a}99{z} ELSE {none} END) WHEN l_quantity<5 AND rn>2 THEN {a}rn-2{z} WHEN l_quantity>40 AND rn>2 THEN {a}rn-1, rn-2{z} ELSE {a}rn-1{z} END"


def h30_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active revision of every order's lines, each made from the line before or, by its quantity, from others."""
    rows = tables.items(spark, sf_dir).select(F.col("l_orderkey").alias("object"), F.col("rn").cast("long").alias("rev"), F.expr(_PARENTS.format(a="array(", z=")", none="cast(array() AS array<int>)")).cast("array<long>").alias("parents"))
    return revisions.resolve(rows)


plan.add(
    "h30_active_versions", h30_versions, "lineitem",
    f"""WITH RECURSIVE rv AS (SELECT l_orderkey AS object, rn AS rev, {_PARENTS.format(a="[", z="]", none="[]")} AS parents FROM {tables._ITEMS} x), l AS (SELECT object, rev, unnest(parents) AS parent FROM rv),
k AS (SELECT l.* FROM l JOIN rv ON rv.object=l.object AND rv.rev=l.parent), reach AS (SELECT object, rev, parent FROM k UNION SELECT r.object, r.rev, k.parent FROM reach r JOIN k ON k.object=r.object AND k.rev=r.parent),
cyc AS (SELECT DISTINCT object FROM reach WHERE rev=parent), hd AS (SELECT object, count(*) AS heads, min(rev) AS head FROM rv WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.object=rv.object AND k.parent=rv.rev) GROUP BY object),
un AS (SELECT DISTINCT object FROM l WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.object=l.object AND rv.rev=l.parent))
SELECT o.object, CASE WHEN c.object IS NULL AND heads=1 THEN head END AS active, CASE WHEN c.object IS NOT NULL THEN 'cycle' WHEN heads>1 THEN 'fork' WHEN u.object IS NOT NULL THEN 'unknown_parent' END AS code
FROM (SELECT DISTINCT object FROM rv) o LEFT JOIN cyc c ON c.object=o.object LEFT JOIN hd ON hd.object=o.object LEFT JOIN un u ON u.object=o.object""",
)

_NOW, _THEN = "l_quantity>8 AND NOT (l_returnflag='R' AND l_quantity>45)", "l_quantity>10"


def v14_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates stored when the graph was another one, against the graph as it is; some names stand in the public text."""
    lines = tables.items(spark, sf_dir).select(F.col("l_orderkey").alias("problem"), F.concat(F.lit("n-"), "l_orderkey", F.lit("-"), "rn").alias("entity"), F.col("l_returnflag").alias("kind"), F.expr(_NOW).alias("now"), F.expr(_THEN).alias("then"), "rn")
    probes = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe"), F.col("o_orderkey").alias("problem"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("N"), F.lit("R"))).alias("kinds"), "o_orderpriority")
    want = candidates.derived(probes, lines.withColumn("visual", F.col("now")), "v")
    stored = candidates.derived(probes, lines.withColumn("visual", F.col("then")), "v")
    view = stored.join(probes.select("probe", "o_orderpriority"), "probe").where("NOT (o_orderpriority LIKE '1%' AND alias = 'E2')").select("probe", "alias", "place")
    public = probes.select("probe", F.concat(F.lit("Which of them? See n-"), "probe", F.when(F.col("o_orderpriority").startswith("5"), "-1").otherwise("-10"), F.lit(".")).alias("text"))
    return candidates.candidate_issues(want, stored, view, public)


_DERIVED = "SELECT probe, target, alias, row_number() OVER (PARTITION BY probe ORDER BY sha256(concat('v:', probe, ':place:', alias)), alias) AS place FROM (SELECT probe, target, 'E'||row_number() OVER (PARTITION BY probe ORDER BY sha256(concat('v:', probe, ':alias:', target)), target) AS alias FROM pool WHERE {}) x"
plan.add(
    "v14_candidate_issues", v14_candidates, "lineitem orders",
    f"""WITH pool AS (SELECT o_orderkey AS probe, o_orderpriority AS pr, 'n-'||l_orderkey||'-'||rn AS target, {_NOW} AS now_, {_THEN} AS then_ FROM {tables._ITEMS} x JOIN orders ON o_orderkey=l_orderkey WHERE o_orderstatus<>'P' OR l_returnflag IN ('N','R')),
w AS ({_DERIVED.format("now_")}), k AS ({_DERIVED.format("then_")}), vw AS (SELECT k.* FROM k JOIN orders ON o_orderkey=probe WHERE NOT (o_orderpriority LIKE '1%' AND alias='E2'))
SELECT coalesce(w.probe, k.probe) AS probe, coalesce(w.target, k.target) AS subject, CASE WHEN k.probe IS NULL THEN 'lost' WHEN w.probe IS NULL THEN 'extra' ELSE 'alias_differs' END AS code FROM w FULL JOIN k ON w.probe=k.probe AND w.target=k.target WHERE w.alias IS DISTINCT FROM k.alias
UNION ALL SELECT probe, alias, 'not_shown' FROM k WHERE NOT EXISTS (SELECT 1 FROM vw WHERE vw.probe=k.probe AND vw.alias=k.alias)
UNION ALL SELECT vw.probe, vw.alias, 'place_differs' FROM vw JOIN w ON w.probe=vw.probe AND w.alias=vw.alias WHERE w.place<>vw.place
UNION ALL SELECT probe, target, 'leak' FROM k JOIN orders ON o_orderkey=probe WHERE target='n-'||probe||CASE WHEN o_orderpriority LIKE '5%' THEN '-1' ELSE '-10' END""",
)

# Public records


def _public(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records (id, instance_id, condition, record) made of parts, of which some break a rule by their size, and the inventory of their images."""
    p = tables.spread(tables.load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("s")))
    p = p.withColumn("condition", F.explode(F.when(F.col("s") == 48, F.array(F.lit("gold"))).otherwise(F.array(F.lit("raw"), F.lit("gold")))))
    s, gold = F.col("s"), F.col("condition") == "gold"
    box = lambda image: F.concat(F.lit('{"kind":"visual","image_id":"'), image, F.lit('","geometry":{"type":"bbox","bbox_1000":[0,0,9,9]}}'))
    candidate = lambda alias: F.concat(F.lit('{"alias":"'), alias, F.lit('","locators":[{"kind":"text"}]}'))
    second = F.when(s == 36, "").otherwise(F.concat(F.lit(","), candidate(F.when(s == 37, "E1").otherwise("E2"))))
    evidence = F.concat(F.lit('{"anchors":{"A1":'), box(F.when(s == 35, "i9").otherwise("i1")), F.lit('},"candidates":['), candidate(F.lit("E1")), second, F.lit("]}"))
    one = lambda anchor, said: F.concat(F.lit('{"anchor_id":"'), F.lit(anchor), F.lit('","text":"'), F.lit(said), F.lit('"}'))
    packet = F.when(gold | (s == 40), F.concat(F.lit("["), F.when(s == 38, one("A9", "x")).when(s == 39, F.concat(one("A1", "x"), F.lit(","), one("A1", "y"))).when(s == 41, one("A1", " ")).otherwise(one("A1", "2 kg")), F.lit("]"))).otherwise("None.")
    bodies = [F.col("p_type"), F.lit("question"), F.lit("A or B"), evidence, F.lit("legend"), F.when(gold & (s == 47), "another question").otherwise("question"), F.lit('{"owner":"string"}'), packet]
    user = F.concat_ws("\n", *(F.concat(F.lit(f"[{m}]\n"), b) for m, b in zip(shared.MARKERS, bodies, strict=True)))
    path = F.concat(F.when(s == 31, "../").otherwise(""), F.lit("images/"), "p_partkey", F.lit(".png"))
    image = lambda i: F.struct(F.lit(i).alias("asset_id"), path.alias("path"), F.sha2(path, 256).alias("sha256"), F.when(s == 45, 0).otherwise(4).alias("width"), F.when(gold & (s == 46), 5).otherwise(3).alias("height"))
    given = F.struct(F.struct(F.lit("system").alias("system"), F.when(s == 42, F.replace(user, F.lit("[Original question]"), F.lit(""))).otherwise(user).alias("user")).alias("messages"), F.when(s == 30, F.array(image("i1"), image("i1"))).otherwise(F.array(image("i1"))).alias("attachments"))
    name = F.col("p_partkey").cast("string")
    fields = [F.lit("public_v1").alias("schema_version"), F.when(s == 44, "").otherwise(name).alias("instance_id"), name.alias("logical_probe_id"), *(F.lit(n).alias(n) for n in ("task_id", "interface", "language", "split")), F.col("condition"), given.alias("input")]
    record = F.to_json(F.struct(*fields, F.when(s == 43, 1).alias("extra")))
    rows = p.select(F.concat("p_partkey", F.lit("-"), "condition").alias("id"), name.alias("instance_id"), "condition", record.alias("record"))
    files = p.where("s <> 33").select(F.concat(F.lit("public/images/"), "p_partkey", F.lit(".png")).alias("path"), F.sha2(F.when(s == 34, F.lit("other")).otherwise(path), 256).alias("sha256")).distinct()
    return rows, files


_SIDES = "(SELECT p_partkey, p_size AS s, c, p_partkey||'-'||c AS id FROM part, (SELECT unnest(['raw','gold']) AS c) q WHERE p_size<>48 OR c='gold') x"
plan.add(
    "h05_record_issues", lambda spark, d: public_records.record_issues(*_public(spark, d)), "part",
    f"""SELECT id, CASE s WHEN 36 THEN 'evidence /candidates' WHEN 43 THEN 'record /extra' WHEN 44 THEN 'record /instance_id' WHEN 31 THEN 'record ../images/'||p_partkey||'.png' WHEN 33 THEN 'record images/'||p_partkey||'.png' WHEN 34 THEN 'record images/'||p_partkey||'.png'
  WHEN 45 THEN 'record /input/attachments/0/width' WHEN 41 THEN 'packet /0/text' ELSE 'record' END AS place, CASE s WHEN 30 THEN 'asset_twice' WHEN 31 THEN 'path_unsafe' WHEN 33 THEN 'hash_missing' WHEN 34 THEN 'hash_differs' WHEN 35 THEN 'image_unattached' WHEN 36 THEN 'minItems' WHEN 37 THEN 'alias_twice'
  WHEN 38 THEN 'anchor_unknown' WHEN 39 THEN 'anchor_twice' WHEN 40 THEN 'packet_in_raw' WHEN 41 THEN 'pattern' WHEN 42 THEN 'sections' WHEN 43 THEN 'additionalProperties' WHEN 44 THEN 'minLength' WHEN 45 THEN 'minimum' END AS code
FROM {_SIDES} WHERE s IN (30,31,33,34,35,36,37,42,43,44,45) OR (s IN (38,39,41) AND c='gold') OR (s=40 AND c='raw')""",
)
plan.add(
    "h05_pairing_issues", lambda spark, d: public_records.pairing_issues(_public(spark, d)[0]), "part",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_size WHEN 46 THEN 'attachments_differ' WHEN 47 THEN 'user_differs' ELSE 'gold_without_raw' END AS code FROM part WHERE p_size IN (46,47,48)",
)

# Audit campaigns


def m11_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over all problems: the first with the defects that the reviewers see, the second without the problems removed by it."""
    p = written(tables.probes(spark, sf_dir).select("problem_id", "probe_id", "probe_type", "interface", "k_candidates", "b_raw", "b_gold", "c_raw"), "campaign")  # read by every step
    catalog = p.select(F.col("problem_id").alias("mother"), F.col("probe_id").alias("item"))
    tags = p.select(F.col("problem_id").alias("mother"), F.explode(F.array(F.concat(F.lit("type:"), "probe_type"), F.concat(F.lit("view:"), "interface"), F.concat(F.lit("size:"), "k_candidates"))).alias("tag"))
    wrong, place = (F.col("b_raw") == 0) & (F.col("b_gold") == 0), F.col("probe_id")
    looks = {"primary": wrong & (F.col("c_raw") == 0) & (F.col("k_candidates") > 7), "secondary": wrong & (F.col("c_raw") == 0) & (F.col("k_candidates") > 6)}

    def reviews(of: campaign.Round) -> DataFrame:
        seen = p.join(F.broadcast(of.items.select(F.col("item").alias("probe_id"), "blind_first")), "probe_id")
        rows = [
            seen.select(
                F.col("probe_id").alias("item"), F.lit(role).alias("role"), F.when(F.coalesce(bad, F.lit(False)), "rejected").otherwise("approved").alias("status"),
                F.when(F.coalesce(bad, F.lit(False)), "serious").otherwise("none").alias("severity"), F.lit(f"{role} reviewer").alias("reviewer"), F.when(F.col("blind_first"), -1).otherwise(place).alias("sequence"),
            )
            for role, bad in looks.items()
        ]
        judge = seen.where(looks["secondary"] & (F.col("interface") == "O")).select(F.col("probe_id").alias("item"), F.lit("adjudication"), F.lit("rejected"), F.lit("serious"), F.lit("third reviewer"), F.lit(0))
        return rows[0].unionByName(rows[1]).union(judge)

    first = campaign.plan_round(catalog, tags, "campaign", 1)
    said = reviews(first)
    bad = campaign.findings(first, said).where("bad").select("mother").distinct()
    second = campaign.plan_round(catalog.join(F.broadcast(bad), "mother", "left_anti"), tags, "campaign", 2)
    outcomes = [campaign.assess(first, said), campaign.assess(second, reviews(second))]
    return spark.createDataFrame([tuple(o.values()) for o in outcomes], ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'long'}" for k, v in outcomes[0].items()))


plan.add("m11_campaign", m11_campaign)  # exact bound and greedy choice; tests hold the operators against plain loops

QUERIES, ORACLES = plan.queries, plan.oracles
