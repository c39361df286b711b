"""Curation: grouping, selection, repair, patches, validators and hash chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import cover
from plumbline.sources import tables

from .base import Plan

plan = Plan()

# Aggregations
plan.sql(
    "a17_control_comparisons", "runs",
    """WITH m AS (SELECT model AS variant, CASE WHEN probe_id%2=0 THEN 'raw' ELSE 'gold' END AS condition, probe_type, problem_id, avg(b) AS v FROM {runs} GROUP BY 1,2,3,4)
SELECT variant, condition, round(sum(v)/3,9) AS BAcc FROM (SELECT variant, condition, probe_type, avg(v) AS v FROM m GROUP BY 1,2,3) t GROUP BY 1,2""",
)
plan.sql(
    "a20_human_means", "runs",
    """WITH i AS (SELECT probe_id, probe_type, problem_id, avg(b) AS v, count(*) AS raters FROM {runs} WHERE model<>'m3' GROUP BY 1,2,3), p AS (SELECT probe_type, problem_id, avg(v) AS v, sum(raters) AS n FROM i GROUP BY 1,2)
SELECT probe_type, count(*) AS problems, CAST(sum(n) AS BIGINT) AS ratings, round(avg(v),9) AS mean FROM p GROUP BY 1""",
)
plan.sql(
    "a27_reference_grouping", "lineitem",
    """SELECT l_orderkey, l_linenumber, CASE WHEN count(DISTINCT l_partkey)=1 THEN 'one' ELSE 'set' END AS cardinality, count(DISTINCT l_partkey) AS targets, min(l_partkey) AS first_target FROM {lineitem} GROUP BY 1,2""",
)
plan.sql("a28_anchor_groups", "boxes", """SELECT image, x0%30 AS anchor, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM {boxes} GROUP BY 1, 2 HAVING count(*)>1""")
plan.sql(
    "a29_group_reasons", "probes",
    """SELECT problem_id, concat(CASE WHEN count(DISTINCT probe_type)>1 THEN 'mixed_types;' ELSE '' END, CASE WHEN count(*)<2 THEN 'single_item;' ELSE '' END, CASE WHEN count(b_raw)<count(*) THEN 'missing_service;' ELSE '' END) AS reasons FROM {probes} GROUP BY problem_id""",
)
plan.sql("a41_versions", "lineitem", """SELECT l_linestatus AS provider, count(DISTINCT CASE WHEN l_suppkey%17<>0 THEN l_linenumber END) AS versions, count(DISTINCT CASE WHEN l_suppkey%17<>0 THEN l_linenumber END)>1 AS several, count(CASE WHEN l_suppkey%17=0 THEN 1 END) AS unavailable FROM {lineitem} GROUP BY 1""")
plan.sql("a42_exclusion_reasons", "pages", """SELECT CASE WHEN instr(html,'<title>')=0 THEN 'no_title' WHEN length(html)<500 THEN 'short' WHEN instr(html,'<script')>0 THEN 'script' ELSE 'kept' END AS reason, count(*) AS n FROM {pages} GROUP BY 1""")
plan.sql("a46_judge_status", "events", """SELECT event_type AS status, count(*) AS n, round(avg(CASE WHEN event_type<>'error' THEN CASE WHEN value>50 THEN 1 ELSE 0 END END),9) AS accuracy FROM {events} GROUP BY 1""")
plan.sql("a12_option_quadrants", "runs", """SELECT a.probe_type, count(CASE WHEN a.b=1 AND c.b=0 THEN 1 END) AS harmed, count(CASE WHEN a.b=0 AND c.b=1 THEN 1 END) AS repaired, count(CASE WHEN a.b=1 AND c.b=1 THEN 1 END) AS both_correct, count(CASE WHEN a.b=0 AND c.b=0 THEN 1 END) AS both_wrong FROM {runs} a JOIN {runs} c ON a.probe_id=c.probe_id AND a.model='m0' AND c.model='m1' GROUP BY 1""")

# Projections and text
plan.sql("p01_adapted_records", "conversations", """SELECT conv_id, turn, concat('c', conv_id, '-', turn) AS record_id, CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE role END AS kind, length(trim(text)) AS n FROM {conversations} WHERE trim(text)<>''""",
         """SELECT conv_id, turn, concat('c', conv_id, '-', turn) AS record_id, CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE role END AS kind, CAST(length(trim(text)) AS INT) AS n FROM conversations WHERE trim(text)<>''""")
plan.sql("p03_prohibited_keys", "events", """SELECT event_type, count(CASE WHEN instr(lower(props),'"k":')>0 THEN 1 END) AS with_key, count(CASE WHEN instr(lower(props),'"answer":')>0 THEN 1 END) AS with_answer FROM {events} GROUP BY 1""")
plan.sql("p14_atomic_selection", "documents", """SELECT doc_id, CASE WHEN n_chars>20000 THEN 'too_long' WHEN lang<>'en' THEN 'language' WHEN row_number() OVER (PARTITION BY CASE WHEN n_chars>20000 OR lang<>'en' THEN 1 ELSE 0 END, source ORDER BY doc_id)>64 THEN 'budget' ELSE 'selected' END AS state FROM {documents}""")
plan.sql("p22_overlay", "documents labels", """SELECT d.doc_id, coalesce(CASE WHEN l.quality=0 THEN 'repaired' END, d.lang) AS lang, l.doc_id IS NOT NULL AS overlaid FROM {documents} d LEFT JOIN {labels} l ON d.doc_id=l.doc_id""")
plan.sql("p24_risk_tags", "part", """SELECT p_partkey, tag FROM {part} LATERAL VIEW explode(array(sha2(p_brand,256), sha2(p_type,256))) t AS tag""", """SELECT p_partkey, unnest([sha256(p_brand), sha256(p_type)]) AS tag FROM part""")
plan.sql("p26_protocol_coalesce", "nation customer", """SELECT n_name, coalesce(max(c_mktsegment), 'none') AS protocol, count(c_custkey) AS runs FROM {nation} LEFT JOIN {customer} ON n_nationkey=c_nationkey AND c_acctbal>5000 GROUP BY 1""")
plan.sql("f05_lenient_object", "responses", """SELECT probe_id, CASE WHEN instr(response,chr(123))>0 AND instr(response,chr(125))>0 THEN substr(response, instr(response,chr(123)), length(response)-instr(reverse(response),chr(125))+2-instr(response,chr(123))) END AS object FROM {responses}""")
plan.sql("f12_context_view", "documents", """SELECT doc_id, substr(text, greatest(p-50,1), p-greatest(p-50,1)) AS prefix, substr(text, p, 5) AS selected, substr(text, p+5, 50) AS suffix FROM (SELECT doc_id, text, instr(text, ' the ') AS p FROM {documents}) x WHERE p>0""")
plan.sql("f14_singleton_basis", "documents", """SELECT doc_id, CASE WHEN regexp_like(lower(text), '^(a|the|le|la|der|die|el) ') THEN 'article' WHEN regexp_like(lower(substr(text,1,20)), '(all|both|each) ') THEN 'plural' ELSE 'none' END AS basis FROM {documents}""",
         """SELECT doc_id, CASE WHEN regexp_matches(lower(text), '^(a|the|le|la|der|die|el) ') THEN 'article' WHEN regexp_matches(lower(substr(text,1,20)), '(all|both|each) ') THEN 'plural' ELSE 'none' END AS basis FROM documents""")
plan.sql("f15_safe_paths", "pages", """SELECT page_id, NOT (instr(url,'..')>0 OR instr(url,' ')>0 OR substr(url,1,1)='/') AS safe FROM {pages}""")
plan.sql("f19_append_options", "part", """SELECT p_partkey, CASE WHEN instr(p_name, p_brand)>0 AND instr(p_name, p_type)>0 THEN p_name ELSE concat(p_name, ' | ', p_brand, ' | ', p_type) END AS text FROM {part}""")
plan.sql("f39_grid_step", "boxes", """SELECT idx, CASE WHEN x1-x0<=25 THEN 25 WHEN x1-x0<=50 THEN 50 WHEN x1-x0<=100 THEN 100 ELSE 250 END AS step FROM {boxes}""")
plan.sql("f52_sealed_records", "orders", """SELECT count(*) AS records, count(CASE WHEN seal=sha2(concat(o_orderkey,':',o_orderstatus),256) THEN 1 END) AS verified FROM (SELECT o_orderkey, o_orderstatus, sha2(concat(o_orderkey,':',CASE WHEN o_custkey%10=0 THEN 'X' ELSE o_orderstatus END),256) AS seal FROM {orders}) x""",
         """SELECT count(*) AS records, count(CASE WHEN seal=sha256(concat(o_orderkey,':',o_orderstatus)) THEN 1 END) AS verified FROM (SELECT o_orderkey, o_orderstatus, sha256(concat(o_orderkey,':',CASE WHEN o_custkey%10=0 THEN 'X' ELSE o_orderstatus END)) AS seal FROM orders) x""")
plan.sql("f54_view_fingerprint", "boxes", """SELECT image, sha2(array_join(array_sort(collect_set(alias)), ','),256) AS fingerprint FROM {boxes} GROUP BY image""", """SELECT image, sha256(array_to_string(list_sort(list(DISTINCT alias)), ',')) AS fingerprint FROM {boxes} GROUP BY image""")

# Joins
plan.sql("j02_coverage", "orders lineitem customer", """SELECT o_orderstatus, count(*) AS joined, count(DISTINCT o_custkey) AS customers FROM {orders} JOIN {lineitem} ON o_orderkey=l_orderkey JOIN {customer} ON o_custkey=c_custkey GROUP BY 1""")
plan.sql("j06_pre_post", "probes", """SELECT probe_type, count(*) AS pairs, count(CASE WHEN b_raw=b_gold THEN 1 END) AS unchanged FROM {probes} WHERE paired AND b_raw IS NOT NULL GROUP BY 1""")
plan.sql("j16_stale_ledger", "documents labels", """SELECT l.doc_id FROM {labels} l LEFT JOIN (SELECT doc_id FROM {documents} WHERE n_chars<2000) d ON l.doc_id=d.doc_id WHERE d.doc_id IS NULL""")
plan.sql("j17_registry_swap", "lineitem", """SELECT l_orderkey, CASE WHEN swap THEN l_suppkey ELSE l_partkey END AS subject, CASE WHEN swap THEN l_partkey ELSE l_suppkey END AS object FROM {lineitem} JOIN (VALUES ('A', true), ('R', false)) AS r(flag, swap) ON l_returnflag=flag""")
plan.sql("j18_all_or_nothing", "lineitem", """SELECT l_orderkey, count(*) AS anchors, count(CASE WHEN l_suppkey%17<>0 THEN 1 END)=count(*) AS resolved FROM {lineitem} GROUP BY 1""")
plan.sql("j20_restore_unique", "lineitem", """SELECT l_orderkey, l_linenumber, CASE WHEN count(*)=1 THEN min(l_partkey) END AS restored, count(*) AS candidates FROM {lineitem} GROUP BY 1,2""")
plan.sql("j24_ordered_tuples", "lineitem", """SELECT l_orderkey, array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> cast(x.l_partkey as string)), ',') AS parts FROM {lineitem} GROUP BY 1""",
         """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1""")

# Windows, repair and selection
plan.sql("w06_neighbour_brackets", "attempts", """SELECT request_id, attempt, max(CASE WHEN kind='completed' THEN attempt END) OVER (PARTITION BY request_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_at, min(CASE WHEN kind='completed' THEN attempt END) OVER (PARTITION BY request_id ORDER BY attempt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_at FROM {attempts}""")
plan.sql("w11_panel_bounds", "boxes", """SELECT image, y0 AS top, lead(y0) OVER (PARTITION BY image ORDER BY y0) AS bottom FROM (SELECT DISTINCT image, y0 FROM {boxes}) x""")
plan.sql("w14_first_response", "attempts", """SELECT request_id, min(attempt) AS attempt FROM {attempts} WHERE kind='completed' GROUP BY request_id""")


def w13_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tables.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("tag"))
    return cover.greedy_cover(tags, budget=5)


plan.add("w13_greedy_cover", w13_greedy_cover)  # sequential choice; a test holds it against a plain loop

# Patches and validators


def v10_apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes, replaces and appends by key, then numbers anew: an anti join, an outer join and a union."""
    base = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    deleted = base.where("id % 11 = 0").select("id")
    replaced = base.where("id % 7 = 0").select("id", F.concat(F.lit("new "), "value").alias("new"))
    appended = base.where("id % 50 = 1").select((F.col("id") + 10_000_000).alias("id"), F.lit("appended").alias("value"))
    kept = base.join(deleted, "id", "left_anti").join(replaced, "id", "left").select("id", F.coalesce("new", "value").alias("value"))
    out = kept.unionByName(appended)
    number = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    return out.select("value", F.col("id").alias("old_id"), F.format_string("%s-%03d", F.col("value"), number).alias("new_id"))


plan.add(
    "v10_apply_patch", v10_apply_patch, "",
    """WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey%7=0 THEN 'new '||p_brand ELSE p_brand END AS value FROM part WHERE p_partkey%11<>0 UNION ALL SELECT p_partkey+10000000, 'appended' FROM part WHERE p_partkey%50=1)
SELECT value, id AS old_id, value||'-'||printf('%03d', row_number() OVER (PARTITION BY value ORDER BY id)) AS new_id FROM k""",
)
plan.sql("v02_node_issues", "boxes", """SELECT image, code, count(*) AS n FROM (SELECT image, CASE WHEN x1>=940 THEN 'out_of_range' WHEN y1=y0 THEN 'degenerate' END AS code FROM {boxes}) x WHERE code IS NOT NULL GROUP BY 1,2""")
plan.sql("v04_mention_order", "conversations", """SELECT conv_id, count(*) AS issues FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations}) x WHERE prev IS NOT NULL AND turn<>prev+1 GROUP BY 1 UNION ALL SELECT -1, count(*) FROM {conversations} WHERE text IS NULL""")
plan.sql("v06_duplicate_signatures", "lineitem", """SELECT l_partkey, l_suppkey, count(*) AS n FROM {lineitem} GROUP BY 1,2 HAVING count(*)>1""")
plan.sql("v09_no_empty_regression", "orders lineitem", """SELECT o_orderkey, coalesce(n,0) AS before_n, coalesce(m,0) AS after_n FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag='R' THEN 1 END) AS m FROM {lineitem} GROUP BY 1) x ON o_orderkey=l_orderkey WHERE coalesce(n,0)>0 AND coalesce(m,0)=0""")
plan.sql("v19_board_issues", "runs", """SELECT model, CASE WHEN min(v)<0 OR max(v)>1 THEN 'domain' WHEN max(v)-min(v)>0.011 THEN 'uneven_types' ELSE 'ok' END AS code FROM (SELECT model, probe_type, avg(b) AS v FROM {runs} GROUP BY 1,2) x GROUP BY 1""")
plan.sql("h55_latest_state", "events", """SELECT user_id, max_by(event_type, ts) AS state, count(*) AS changes FROM {events} GROUP BY 1""")
plan.sql("h57_last_assistant", "conversations", """SELECT conv_id, max_by(text, turn) AS answer FROM {conversations} WHERE role='assistant' GROUP BY 1""")
plan.sql("h38_batch_identity", "documents", """SELECT source, lang, count(*) AS n, count(DISTINCT doc_id)=count(*) AS is_unique FROM {documents} GROUP BY 1,2""")

QUERIES, ORACLES = plan.queries, plan.oracles
