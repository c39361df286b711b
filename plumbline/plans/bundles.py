"""Prompts, bundles, controls, locators, plans and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import prompts, strict_json
from plumbline.operators import pools
from plumbline.operators.bootstrap import numbered
from plumbline.operators.components import connected_components, shared_folder
from plumbline.sources import bundle, shared, tables
from plumbline.sources.shared import MARKERS

from .base import Plan, frames

plan = Plan()
EQUAL = {"A": 1 / 3, "N": 1 / 3, "R": 1 / 3}


def add(name: str, relations: str, query, duck: str) -> None:
    """A query over shared relations: ``query`` takes their frames by name."""
    plan.queries[name] = lambda spark, d: query(*(shared.relation(spark, d, n) for n in relations.split()))
    plan.oracles[name] = shared.duck(relations, duck)


def _squeezed(text):
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def derived(name: str, relations: str, query, duck: str) -> None:
    """The same over tables and the relations of ``sources.tables``."""
    plan.add(name, lambda spark, d: query(*frames(spark, d, relations).values()), relations, duck)


# Prompts

_parts = lambda df: df.select("*", F.explode(F.array(prompts.sections(F.col("user_text")))).alias("parts"))
add(
    "p04_sections", "prompts",
    lambda p: _parts(p).select("item", F.col("parts").isNotNull().alias("ok"), *(F.element_at("parts", F.lit(MARKERS[k])).alias(n) for k, n in ((0, "statement"), (3, "evidence"), (5, "local_question"), (7, "packet")))),
    "SELECT item, fault<7 AS ok, CASE WHEN fault<7 THEN statement END AS statement, CASE WHEN fault<7 THEN evidence END AS evidence, CASE WHEN fault<7 THEN local_question END AS local_question, CASE WHEN fault<7 THEN 'None.' END AS packet FROM prompts",
)
add(
    "p05_image_ids", "prompts",
    lambda p: p.select("item", F.array_join(prompts.image_ids(F.col("legend")), "|").alias("ids")),
    "SELECT item, CASE WHEN item%13<>0 THEN CASE WHEN legend LIKE '%, i2%' THEN 'i1|i2' ELSE 'i1' END END AS ids FROM prompts",
)
add(
    "p08_nearest_eligibility", "prompts",
    lambda p: p.select("item", F.from_json("evidence", prompts.EVIDENCE).alias("e")).select(
        "item",
        F.when(F.element_at("e.anchors", F.lit("A1"))["kind"] != "visual", "anchor_not_visual")
        .when(~F.forall("e.candidates", lambda c: F.exists(c["locators"], lambda x: x["kind"] == "visual")), "candidate_without_region").otherwise("eligible").alias("reason"),
    ),
    """SELECT item, CASE WHEN json_extract_string(evidence,'$.anchors.A1.kind')<>'visual' THEN 'anchor_not_visual' WHEN len(list_filter(range(n_candidates), lambda i: NOT contains(CAST(json_extract(evidence, '$.candidates['||i||']') AS VARCHAR), '"visual"')))>0 THEN 'candidate_without_region' ELSE 'eligible' END AS reason FROM prompts""",
)
add(
    "p15_without_geometry", "prompts",
    lambda p: p.select("item", prompts.without_geometry(F.col("evidence")).alias("evidence")),
    """SELECT item, concat('{"anchors":{"A1":', CASE WHEN json_extract_string(evidence,'$.anchors.A1.kind')='visual' THEN '{"kind":"withheld_visual_anchor"}' ELSE '{"kind":"text","ref":"a1"}' END, ',"A2":{"kind":"text","ref":"a2"}},"candidates":[{"alias":"E1","locators":[{"kind":"text","ref":"t1"}]},{"alias":"E2","locators":[]}',
  CASE WHEN n_candidates>=3 THEN ',{"alias":"E3","locators":[{"kind":"text","ref":"r3"}]}' ELSE '' END, CASE WHEN n_candidates>=4 THEN ',{"alias":"E4","locators":[]}' ELSE '' END, ']}') AS evidence FROM prompts""",
)


def permuted(p: DataFrame) -> DataFrame:
    """item, mapping (alias to alias) and order of its candidates; both never the identity."""
    rows = p.select("item", "local_question", F.transform(F.from_json("evidence", prompts.EVIDENCE)["candidates"], lambda c: c["alias"]).alias("aliases"))
    seed = lambda mode: (F.lit("5"), F.col("item").cast("string"), F.lit(mode))
    order = prompts.shuffled(F.sequence(F.lit(0), F.size("aliases") - 1), *seed("order"))
    return rows.select("item", "local_question", "aliases", prompts.shuffled(F.col("aliases"), *seed("alias")).alias("names"), order.alias("places"))


_perm = """a AS (SELECT item, local_question, list_transform(range(1, n_candidates+1), lambda k: 'E'||k) AS aliases, range(n_candidates) AS ix FROM prompts),
h AS (SELECT item, local_question, aliases, list_transform(list_sort(list_transform(aliases, lambda x: {k: sha256(concat('5:', item, ':alias:', x)), x: x})), lambda s: s.x) AS n0,
  ix, list_transform(list_sort(list_transform(ix, lambda x: {k: sha256(concat('5:', item, ':order:', x)), x: x})), lambda s: s.x) AS o0 FROM a),
m AS (SELECT item, local_question, aliases, CASE WHEN n0=aliases THEN list_concat(aliases[2:], aliases[:1]) ELSE n0 END AS names, CASE WHEN o0=ix THEN list_concat(ix[2:], ix[:1]) ELSE o0 END AS places FROM h)"""
add(
    "p16_permutation", "prompts",
    lambda p: permuted(p).withColumnRenamed("names", "n").select(
        "item", F.array_join("n", ",").alias("names"), F.array_join(F.transform("places", lambda i: F.get("n", i)), ",").alias("shown"), (F.array_sort("n") == F.array_sort("aliases")).alias("bijection")
    ),
    f"WITH {_perm} SELECT item, array_to_string(names, ',') AS names, array_to_string(list_transform(places, lambda i: names[i+1]), ',') AS shown, true AS bijection FROM m",
)
add("o06_shuffle", "prompts", lambda p: permuted(p).select("item", F.array_join("places", ",").alias("places")), f"WITH {_perm} SELECT item, array_to_string(places, ',') AS places FROM m")
add(
    "f17_replace_aliases", "prompts",
    lambda p: permuted(p).select("item", prompts.replace_aliases(F.col("local_question"), F.map_from_arrays("aliases", "names")).alias("text")),
    f"WITH {_perm} SELECT item, array_to_string(list_transform(regexp_extract_all(local_question, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: coalesce(names[list_position(aliases, w)], w)), '') AS text FROM m",
)
add(
    "f25_remap_answers", "prompts",
    lambda p: permuted(p).select("item", F.map_from_arrays("aliases", F.transform("aliases", lambda a: F.concat(F.lit("t-"), a))).alias("domain"), F.map_from_arrays("aliases", "names").alias("mapping")).select(
        "item", F.array_join(F.transform(F.array_sort(F.map_entries(F.transform_keys("domain", lambda k, _: F.element_at("mapping", k)))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("domain")
    ),
    f"WITH {_perm} SELECT item, array_to_string(list_sort(list_transform(range(1, len(names)+1), lambda i: names[i]||'=t-'||aliases[i])), ',') AS domain FROM m",
)
add(
    "f18_templates", "prompts",
    lambda p: p.select("item", F.lit("Is {subject} {relation} {object}, given {subject}?").alias("t"), F.create_map(F.lit("subject"), F.lit("E1"), F.lit("object"), F.col("question"), F.when(F.col("item") % 4 != 0, F.lit("relation")).otherwise(F.lit("other")), F.lit("above")).alias("v")).select(
        "item", F.array_join(prompts.placeholders(F.col("t")), ",").alias("names"), prompts.render(F.col("t"), F.col("v")).alias("text")
    ),
    "SELECT item, 'object,relation,subject' AS names, CASE WHEN item%4<>0 THEN 'Is E1 above '||question||', given E1?' END AS text FROM prompts",
)
add(
    "h04_item_accessors", "prompts",
    lambda p: _parts(p).where("parts is not null").select("item", F.concat_ws("/", F.col("item").cast("string"), F.lit("raw")).alias("item_key"), F.sha2("user_text", 256).alias("input_hash"), F.size("parts").cast("long").alias("n_parts"), F.nullif(F.element_at("parts", F.lit(MARKERS[7])), F.lit("None.")).alias("packet")),
    "SELECT item, item||'/raw' AS item_key, sha256(user_text) AS input_hash, CAST(8 AS BIGINT) AS n_parts, CAST(NULL AS VARCHAR) AS packet FROM prompts WHERE fault<7",
)
add(
    "h37_question_closure", "prompts",
    lambda p: p.select("item", (F.array_sort(F.array_distinct(F.regexp_extract_all("local_question", F.lit("(?<!\\w)E\\d+(?!\\w)"), F.lit(0)))) == F.array(F.lit("E1"), F.lit("E10"), F.lit("E2"))).alias("closed")),
    "SELECT item, local_question LIKE '%See E1.' OR local_question LIKE '%See E2.' AS closed FROM prompts",
)
add(
    "f53_semantics_hash", "prompts",
    lambda p: p.select("item", F.sha2(F.to_json(F.struct(F.col("n_candidates").alias("n"), F.col("question").alias("q"))), 256).alias("h")),
    """SELECT item, sha256(concat('{"n":', n_candidates, ',"q":"', question, '"}')) AS h FROM prompts""",
)

# Locators

def _status():
    return prompts.locator_status(F.col("text"), F.col("first"), F.col("stop"), F.col("quote"))



_kinds = "CASE kind WHEN 1 THEN 'offset_out_of_range' WHEN 2 THEN 'quote_mismatch' ELSE 'ok' END"
add("f33_locator_status", "locators", lambda x: x.select("conv_id", "turn", _status().alias("status")), f"SELECT conv_id, turn, {_kinds} AS status FROM locators")
add(
    "v23_locator_counts", "locators",
    lambda x: x.groupBy(_status().alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations")),
    f"SELECT {_kinds} AS status, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM locators GROUP BY 1",
)
add(
    "h35_inline_tags", "locators",
    lambda x: x.where(_status() == "ok").select("conv_id", "turn", F.concat(F.substring("text", F.lit(1), F.col("first")), F.lit("<A1>"), F.col("quote"), F.lit("</A1>"), F.substring("text", F.col("stop") + 1, F.length("text"))).alias("tagged")),
    "SELECT conv_id, turn, text[1:first]||'<A1>'||quote||'</A1>'||text[stop+1:] AS tagged FROM locators WHERE kind=0",
)

# Bundles and truth


def write_bundle(p: DataFrame, root: str) -> None:
    """A bundle on disk: raw items, gold items of every second one, the private truth and the inventory of it all."""
    item = F.struct(F.col("item").cast("string").alias("instance_id"), "user_text")
    bundle.publish(p.select(item.alias("x")).select("x.*"), f"{root}/public/qa_raw")
    bundle.publish(p.where("item % 2 = 0").select(item.alias("x")).select("x.*"), f"{root}/public/qa_gold")
    truth = F.struct(F.col("item").cast("string").alias("instance_id"), F.concat(F.lit("T0"), (F.col("fault") % 3).cast("string")).alias("probe_type"), F.array(F.lit("E1")).alias("gold"))
    bundle.publish(p.where("fault < 7").select(truth.alias("x")).select("x.*"), f"{root}/private/probes")
    bundle.inventory(p.sparkSession, root).write.parquet(f"{root}-inventory")


def _bundle(p: DataFrame) -> str:
    write_bundle(p, root := f"{shared_folder(p.sparkSession)}/plumbline/bundle-{uuid.uuid4().hex}")
    return root


ITEM, TRUTH = "instance_id string, user_text string", "instance_id string, probe_type string, gold array<string>"


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """condition, instance_id, user_text of the raw items and, where there are any, the gold ones; every line is a strict object."""
    parts = [bundle.read_jsonl(spark, f"{root}/public/qa_{c}").select(F.lit(c).alias("condition"), F.from_json("record", ITEM).alias("x")) for c in ("raw", "gold")]
    return parts[0].unionByName(parts[1]).select("condition", "x.*")


add(
    "s05_bundle_scan", "prompts",
    lambda p: read_bundle(p.sparkSession, _bundle(p)).select("condition", "instance_id", F.sha2("user_text", 256).alias("input_hash")),
    "SELECT 'raw' AS condition, CAST(item AS VARCHAR) AS instance_id, sha256(user_text) AS input_hash FROM prompts UNION ALL SELECT 'gold', CAST(item AS VARCHAR), sha256(user_text) FROM prompts WHERE item%2=0",
)


def s06_truth(p: DataFrame) -> DataFrame:
    """Public items met with their private truth; items of which either is lacking show as such."""
    spark, root = p.sparkSession, _bundle(p)
    raw = read_bundle(spark, root).where("condition = 'raw'").select("instance_id", F.lit(True).alias("public"))
    truth = bundle.read_jsonl(spark, f"{root}/private/probes").select(F.from_json("record", TRUTH).alias("x")).select("x.*")
    both = raw.join(truth, "instance_id", "full_outer")
    return both.select("instance_id", "probe_type", F.get("gold", F.lit(0)).alias("gold"), F.when(F.col("public").isNull(), "no_item").when(F.col("probe_type").isNull(), "no_truth").otherwise("ok").alias("state"))


add("s06_truth", "prompts", s06_truth, "SELECT CAST(item AS VARCHAR) AS instance_id, CASE WHEN fault<7 THEN 'T0'||(fault%3) END AS probe_type, CASE WHEN fault<7 THEN 'E1' END AS gold, CASE WHEN fault<7 THEN 'ok' ELSE 'no_truth' END AS state FROM prompts")


def s07_release_scan(p: DataFrame) -> DataFrame:
    """Files of a release whose bytes differ from the inventory, after one file was changed and one added."""
    spark, root = p.sparkSession, _bundle(p)
    bundle.publish(p.limit(1).select(F.lit(1).alias("x")), f"{root}/late")
    want = spark.read.parquet(f"{root}-inventory")
    changed = want.select(F.min("path").alias("path")).select("path", F.lit("0" * 64).alias("other"))
    want = want.join(changed, "path", "left").select("path", F.coalesce("other", "sha256").alias("sha256"))
    issues = bundle.integrity_issues(bundle.inventory(spark, root), want)
    return issues.where("path not like '%SUCCESS'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


plan.queries["s07_release_scan"] = lambda spark, d: s07_release_scan(shared.relation(spark, d, "prompts"))
plan.oracles["s07_release_scan"] = "SELECT 'changed' AS code, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'unexpected', 1"
derived(
    "s11_paged_cache", "documents",
    lambda d: d.where("doc_id % 977 <> 5").groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).select(
        "page", "rows", ((F.col("lo") == F.col("page") * 100) & (F.col("hi") - F.col("lo") + 1 == F.col("rows"))).alias("contiguous"), (F.col("rows") == 100).alias("complete")
    ),
    "WITH e AS (SELECT doc_id//100 AS page, list_sort(list(doc_id)) AS ids FROM {documents} WHERE doc_id%977<>5 GROUP BY 1) SELECT page, CAST(len(ids) AS BIGINT) AS rows, ids=range(page*100, page*100+len(ids)) AS contiguous, len(ids)=100 AS complete FROM e",
)

# Plans and reports


def m01_plan(probes: DataFrame) -> DataFrame:
    """Requests of the test split in order: reserved problems and all their clusters are out; gold only where exported."""
    split = probes.where("cluster_id % 2 = 0")
    reserved = split.where("problem_id % 97 = 0").select("cluster_id").distinct()
    rows = split.join(reserved, "cluster_id", "left_anti").select("probe_id", "problem_id", F.explode(F.when(F.col("paired"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("c"))
    keyed = rows.select(F.col("probe_id"), "problem_id", "c", (F.col("probe_id") * 2 + F.col("c")).alias("cluster_id"))
    seq = numbered(keyed.select("cluster_id"))
    return keyed.join(seq, "cluster_id").select("probe_id", F.when(F.col("c") == 0, "raw").otherwise("gold").alias("condition"), F.col("ix").cast("long").alias("seq"), F.sha2(F.concat_ws("/", F.col("probe_id").cast("string"), F.col("c").cast("string")), 256).alias("request_id"))


derived(
    "m01_prepare_plan", "probes", m01_plan,
    """WITH s AS (SELECT * FROM {probes} WHERE cluster_id%2=0), ok AS (SELECT * FROM s WHERE cluster_id NOT IN (SELECT cluster_id FROM s WHERE problem_id%97=0)),
r AS (SELECT probe_id, 0 AS c FROM ok UNION ALL SELECT probe_id, 1 FROM ok WHERE paired)
SELECT probe_id, CASE c WHEN 0 THEN 'raw' ELSE 'gold' END AS condition, row_number() OVER (ORDER BY probe_id, c)-1 AS seq, sha256(concat(probe_id, '/', c)) AS request_id FROM r""",
)
plan.queries["o01_plan_order"] = lambda spark, d: m01_plan(tables.probes(spark, d)).select("probe_id", "condition", "seq")
plan.oracles["o01_plan_order"] = f"SELECT probe_id, condition, seq FROM ({plan.oracles['m01_prepare_plan']}) x"


def m02_report(probes: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests met with answers and truth, scored and averaged: a missing answer bounds the mean, a faulty one scores 0."""
    answered = probes.where("b_raw is not null").select("probe_id")
    got = responses.join(answered, "probe_id", "left_semi").withColumn("o", strict_json.strict_json("response")).select("probe_id", F.coalesce((strict_json.owner_of(F.col("o")) == "E1").cast("int"), F.lit(0)).alias("b"))
    rows = probes.select("probe_id", "problem_id", "probe_type").join(got, "probe_id", "left")
    return pools.rounded(pools.type_means(rows, "b")).select("probe_type", "n_problems", "n_probes", "n_missing", "lower_v", "upper_v", "coverage")


derived(
    "m02_score_report", "probes responses", m02_report,
    """WITH g AS (SELECT r.probe_id, CASE WHEN variant IN (0,6,7) AND response LIKE '%"owner":"%E1%"%' THEN 1 ELSE 0 END AS b FROM {responses} r JOIN {probes} p ON p.probe_id=r.probe_id WHERE p.b_raw IS NOT NULL),
m AS (SELECT probe_type, problem_id, count(*) AS m, sum(coalesce(b,0)) AS s0, sum(coalesce(b,1)) AS s1, count(b) AS k FROM {probes} p LEFT JOIN g ON p.probe_id=g.probe_id GROUP BY 1,2)
SELECT probe_type, count(*) AS n_problems, CAST(sum(m) AS BIGINT) AS n_probes, CAST(sum(m-k) AS BIGINT) AS n_missing, round(avg(s0/m),9) AS lower_v, round(avg(s1/m),9) AS upper_v, round(avg(k/m),9) AS coverage FROM m GROUP BY 1""",
)


def k05_export(probes: DataFrame) -> DataFrame:
    """Predictions as JSONL in plan order, in files that are ordered too, and read back."""
    rows = m01_plan(probes).orderBy("seq").select("seq", "probe_id", "condition")
    bundle.publish(rows, path := f"{shared_folder(probes.sparkSession)}/plumbline/export-{uuid.uuid4().hex}")
    back = bundle.read_jsonl(probes.sparkSession, path).select(F.col("path"), F.from_json("record", "seq long, probe_id long, condition string").alias("x")).select("path", "x.*")
    return back.groupBy("path").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("records"), F.count(F.when(F.col("hi") - F.col("lo") + 1 != F.col("n"), 1)).alias("files_out_of_order"))


plan.queries["k05_plan_order_export"] = lambda spark, d: k05_export(tables.probes(spark, d))
plan.oracles["k05_plan_order_export"] = f"SELECT count(*) AS records, CAST(0 AS BIGINT) AS files_out_of_order FROM ({plan.oracles['m01_prepare_plan']}) x"


def k07_comparison(runs: DataFrame) -> DataFrame:
    """One row per type and one column per model, through CSV."""
    wide = pools.type_means(runs, "b", ["model"]).groupBy("probe_type").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.round(F.first("value"), 9))
    wide.write.option("header", True).csv(path := f"{shared_folder(runs.sparkSession)}/plumbline/comparison-{uuid.uuid4().hex}")
    return runs.sparkSession.read.option("header", True).schema("probe_type string, m0 double, m1 double, m2 double, m3 double").csv(path)


derived(
    "k07_comparison_table", "runs", k07_comparison,
    "WITH m AS (SELECT model, probe_type, problem_id, avg(b) AS v FROM {runs} GROUP BY 1,2,3), t AS (SELECT model, probe_type, round(avg(v),9) AS v FROM m GROUP BY 1,2) SELECT probe_type, max(CASE WHEN model='m0' THEN v END) AS m0, max(CASE WHEN model='m1' THEN v END) AS m1, max(CASE WHEN model='m2' THEN v END) AS m2, max(CASE WHEN model='m3' THEN v END) AS m3 FROM t GROUP BY 1",
)


def j22_human_model(runs: DataFrame) -> DataFrame:
    """Humans (m0, m1) against a model (m3) on the probes that all humans answered alike: both means over the same subset."""
    wide = runs.groupBy("probe_id", "problem_id", "probe_type").agg(F.avg(F.when(F.col("model").isin("m0", "m1"), F.col("b"))).alias("h"), F.max(F.when(F.col("model") == "m3", F.col("b"))).alias("m"))
    same = wide.where("h in (0, 1)")
    side = lambda c: pools.combine(pools.type_means(same, c), EQUAL).select(F.col("value").alias(c))
    return pools.rounded(side("h").crossJoin(side("m")).select(F.col("h").alias("human"), F.col("m").alias("model"), (F.col("m") - F.col("h")).alias("delta")))


derived(
    "j22_human_model", "runs", j22_human_model,
    """WITH h AS (SELECT a.probe_id, a.problem_id, a.probe_type, a.b AS h, c.b AS m FROM {runs} a JOIN {runs} b ON a.probe_id=b.probe_id AND b.model='m1' AND a.b=b.b JOIN {runs} c ON a.probe_id=c.probe_id AND c.model='m3' WHERE a.model='m0'),
p AS (SELECT probe_type, problem_id, avg(h) AS h, avg(m) AS m FROM h GROUP BY 1,2), t AS (SELECT probe_type, avg(h) AS h, avg(m) AS m FROM p GROUP BY 1) SELECT round(sum(h)/3,9) AS human, round(sum(m)/3,9) AS model, round(sum(m)/3-sum(h)/3,9) AS delta FROM t""",
)


def _targets():
    return F.create_map(F.lit("E1"), F.lit("object-a"), F.lit("E2"), F.lit("object-b"))



derived(
    "j04_canonical_alias", "responses",
    lambda r: r.select("probe_id", strict_json.owner_of(strict_json.strict_json("response")).alias("alias")).where("alias is not null").select("probe_id", "alias", F.element_at(_targets(), F.col("alias")).alias("target")),
    """WITH x AS (SELECT probe_id, trim(regexp_extract(response, '"owner":"([^"]*)"', 1)) AS alias FROM {responses} WHERE variant IN (0,6,7)) SELECT probe_id, alias, CASE alias WHEN 'E1' THEN 'object-a' WHEN 'E2' THEN 'object-b' END AS target FROM x""",
)
derived(
    "j14_three_way_coverage", "documents labels",
    lambda d, lab: d.select("doc_id", F.lit(1).alias("c")).join(lab.select("doc_id", F.lit(1).alias("k")), "doc_id", "full_outer").join(d.where("n_chars > 500").select("doc_id", F.lit(1).alias("p")), "doc_id", "full_outer").groupBy(
        F.col("c").isNotNull().alias("in_catalog"), F.col("k").isNotNull().alias("in_keys"), F.col("p").isNotNull().alias("in_private")
    ).agg(F.count(F.lit(1)).alias("n")),
    "WITH ids AS (SELECT doc_id FROM {documents} UNION SELECT doc_id FROM {labels}) SELECT doc_id IN (SELECT doc_id FROM {documents}) AS in_catalog, doc_id IN (SELECT doc_id FROM {labels}) AS in_keys, doc_id IN (SELECT doc_id FROM {documents} WHERE n_chars>500) AS in_private, count(*) AS n FROM ids GROUP BY 1,2,3",
)

# Identity, reviews, hashes


def a25_identity(entities: DataFrame, same: DataFrame) -> DataFrame:
    """Components of identity edges; one whose members have several types is a conflict."""
    cc = connected_components(same)
    return cc.join(entities, cc["node"] == entities["entity"]).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.when(F.countDistinct("kind") == 1, "ok").otherwise("type_conflict").alias("state"))


add(
    "a25_identity_closure", "entities same_entity", a25_identity,
    """WITH RECURSIVE e AS (SELECT a, b FROM same_entity UNION SELECT b, a FROM same_entity), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other=e.a),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT component, count(*) AS members, CASE WHEN count(DISTINCT kind)=1 THEN 'ok' ELSE 'type_conflict' END AS state FROM c JOIN entities ON node=entity GROUP BY 1""",
)


def review_states(actions: DataFrame) -> DataFrame:
    """State of each stage: approved if its last action approved it and no earlier stage was reopened since; else draft or stale."""
    reopens = F.max(F.when(F.col("action") != "approve", F.col("seq")))
    last = actions.groupBy("record", "stage").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"), reopens.alias("reopened"))
    before = F.max("reopened").over(Window.partitionBy("record").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1))
    return last.select("record", "stage", F.when(F.col("action") != "approve", "draft").when(before > F.col("seq"), "stale").otherwise("approved").alias("state"))


add(
    "t07_review_states", "actions", review_states,
    """WITH l AS (SELECT record, stage, max(seq) AS seq FROM actions GROUP BY 1,2), x AS (SELECT l.record, l.stage, l.seq, a.action FROM l JOIN actions a ON a.record=l.record AND a.stage=l.stage AND a.seq=l.seq)
SELECT record, stage, CASE WHEN action<>'approve' THEN 'draft' WHEN EXISTS (SELECT 1 FROM actions e WHERE e.record=x.record AND e.stage<x.stage AND e.action<>'approve' AND e.seq>x.seq) THEN 'stale' ELSE 'approved' END AS state FROM x""",
)
add(
    "p12_all_approved", "actions",
    lambda a: review_states(a).groupBy("record").agg(F.every(F.col("state") == "approved").alias("ok")).where("ok").select("record"),
    """WITH l AS (SELECT record, stage, max(seq) AS seq FROM actions GROUP BY 1,2), x AS (SELECT l.*, a.action FROM l JOIN actions a USING (record, stage, seq)),
bad AS (SELECT x.record FROM x WHERE action<>'approve' UNION SELECT x.record FROM x JOIN actions e ON e.record=x.record AND e.stage<x.stage AND e.action<>'approve' AND e.seq>x.seq) SELECT DISTINCT record FROM actions WHERE record NOT IN (SELECT record FROM bad)""",
)


def chained(journal: DataFrame) -> DataFrame:
    """Each record's hash and the hash it names for the one before it."""
    order = Window.partitionBy("chain").orderBy("seq")
    rows = journal.select("*", F.sha2(F.concat_ws("|", F.col("chain").cast("string"), F.col("seq").cast("string"), "kind"), 256).alias("record_hash"))
    return rows.select("chain", "seq", "record_hash", F.when(F.col("broken"), F.lit("0" * 64)).otherwise(F.lag("record_hash").over(order)).alias("previous_hash"))


def verify_chain(records: DataFrame) -> DataFrame:
    """chain, links and the first record whose named hash is not that of the record before it; null if all hold."""
    order = Window.partitionBy("chain").orderBy("seq")
    held = records.select("chain", "seq", F.col("previous_hash").eqNullSafe(F.lag("record_hash").over(order)).alias("ok"))
    return held.groupBy("chain").agg(F.count(F.lit(1)).alias("links"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_broken"))


add("h44_hash_chain", "journal", lambda j: verify_chain(chained(j)), "SELECT chain, count(*) AS links, min(CASE WHEN broken THEN seq END) AS first_broken FROM journal GROUP BY 1")
derived(
    "v18_reaudit", "runs",
    lambda r: pools.type_means(r, "b", ["model"]).select("model", "probe_type", F.round("value", 6).alias("v")).select("*", F.when((F.col("probe_type") == "N") & (F.col("model") == "m2"), F.col("v") + 0.01).otherwise(F.col("v")).alias("reported"), F.when(F.col("model") == "m1", 1.5).otherwise(F.col("v") + 0.02).alias("hi")).select(
        "model", "probe_type", F.when(F.abs(F.col("reported") - F.col("v")) > 1e-9, "value_differs").when(F.col("hi") > 1, "interval_outside_domain").otherwise("ok").alias("code")
    ),
    "SELECT DISTINCT model, probe_type, CASE WHEN model='m2' AND probe_type='N' THEN 'value_differs' WHEN model='m1' THEN 'interval_outside_domain' ELSE 'ok' END AS code FROM {runs}",
)
derived(
    "f08_statement_match", "conversations",
    lambda c: c.where("text <> ''").select("conv_id", "turn", "text", F.expr("CASE conv_id%4 WHEN 0 THEN text WHEN 1 THEN concat('  ', replace(text, ' ', '  '), chr(10)) WHEN 2 THEN substr(text, 2) ELSE concat('zz', reverse(text)) END").alias("other")).select(
        "conv_id", "turn", F.when(F.col("text") == F.col("other"), "exact").when(_squeezed(F.col("text")) == _squeezed(F.col("other")), "whitespace").when(F.contains("text", "other"), "contained").otherwise("different").alias("match")
    ),
    "SELECT conv_id, turn, CASE conv_id%4 WHEN 0 THEN 'exact' WHEN 1 THEN 'whitespace' WHEN 2 THEN 'contained' ELSE 'different' END AS match FROM {conversations} WHERE text<>''",
)
derived(
    "j21_grade_by_hash", "orders",
    lambda o: o.select("o_orderkey", F.sha2("o_orderpriority", 256).alias("r"), F.sha2("o_orderstatus", 256).alias("t")).join(
        o.select("o_orderkey", F.sha2(F.when(F.col("o_custkey") % 3 == 0, "changed").otherwise(F.col("o_orderpriority")), 256).alias("r"), F.sha2(F.when(F.col("o_custkey") % 5 == 0, "other").otherwise(F.col("o_orderstatus")), 256).alias("t"), (F.col("o_custkey") % 2).alias("grade")),
        ["o_orderkey", "r", "t"],
    ).groupBy("grade").agg(F.count(F.lit(1)).alias("graded")),
    "SELECT o_custkey%2 AS grade, count(*) AS graded FROM {orders} WHERE o_custkey%3<>0 AND o_custkey%5<>0 GROUP BY 1",
)
QUERIES, ORACLES = plan.queries, plan.oracles
