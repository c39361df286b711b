"""Joins, set operations, text, geometry, validation and journal queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import audit, grading, strict_json, variants
from plumbline.operators import nearest
from plumbline.operators.components import connected_components
from plumbline.operators.occurrences import quote_spans
from plumbline.sources import tables

from .base import Plan

plan = Plan()

# Scalars and text


def f04_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.responses(spark, sf_dir).withColumn("o", strict_json.strict_json("response"))
    return df.select("probe_id", F.col("o").isNotNull().alias("object_valid"), strict_json.owner_of(F.col("o")).alias("owner"))


plan.add("f04_strict_json", f04_strict_json, "responses", """SELECT probe_id, variant IN (0,5,6,7) AS object_valid, CASE WHEN variant IN (0,6,7) THEN trim(regexp_extract(response,'"owner":"([^"]*)"',1)) END AS owner FROM {responses}""")


def f20_item_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading C, binding B and their product; a faulty answer scores 0, never null."""
    parsed = tables.responses(spark, sf_dir).withColumn("o", strict_json.strict_json("response"))
    read = strict_json.ocr_normal(F.coalesce(F.get_json_object("o", "$.read"), F.lit("")))
    c = F.coalesce((read == "2 kg").cast("int"), F.lit(0))
    b = F.coalesce((strict_json.owner_of(F.col("o")) == "E1").cast("int"), F.lit(0))
    return parsed.select("probe_id", c.alias("C"), b.alias("B")).select("*", (F.col("C") * F.col("B")).alias("J"))


plan.add(
    "f20_item_score", f20_item_score, "responses",
    """WITH x AS (SELECT probe_id, CASE WHEN variant IN (0,5,6,7) AND replace(regexp_extract(response,'"read":"([^"]*)"',1),' ','')='2kg' THEN 1 ELSE 0 END AS C,
  CASE WHEN variant IN (0,6,7) AND trim(regexp_extract(response,'"owner":"([^"]*)"',1))='E1' THEN 1 ELSE 0 END AS B FROM {responses}) SELECT probe_id, C, B, C*B AS J FROM x""",
)


def f01_ocr_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("\\,\\mathrm{kg}$")).alias("raw"))
    return p.select("p_partkey", strict_json.ocr_normal("raw").alias("normal"))


plan.add("f01_ocr_norm", f01_ocr_norm, "", "SELECT p_partkey, p_size||' kg' AS normal FROM part")


def f03_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = strict_json.quantity_equal({"g": "1/1000", "kg": "1"}, "0.002")
    p = tables.load(spark, sf_dir, "part")
    return p.select("p_partkey", same(F.concat(F.col("p_size").cast("string"), F.lit(" g")), F.concat(F.format_string("%.3f", (F.col("p_partkey") % 50) / 1000), F.lit(" kg"))).alias("equal"))


plan.add("f03_quantity", f03_quantity, "", "SELECT p_partkey, abs(p_size - p_partkey%50) <= 2 AS equal FROM part")
plan.sql(
    "f06_text_identity", "pages",
    r"""SELECT page_id, sha2(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \\t\\n\\r]+', ' ')), 256) AS identity FROM {pages}""",
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS identity FROM pages""",
)
plan.sql(
    "f07_titles", "pages",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n_chars FROM {pages}""",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(length(html) AS BIGINT) AS n_chars FROM pages""",
)
plan.sql(
    "f10_split_stem_query", "conversations",
    """SELECT conv_id, turn, CASE WHEN instr(text, chr(10))>0 THEN 'newline' WHEN instr(text, '. ')>0 THEN 'sentence' ELSE 'whole' END AS method,
  CASE WHEN instr(text, chr(10))>0 THEN instr(text, chr(10)) WHEN instr(text, '. ')>0 THEN instr(text, '. ')+1 ELSE length(text) END AS stem_chars FROM {conversations}""",
)
plan.sql(
    "f16_latex_escape", "part",
    """SELECT p_partkey, replace(replace(replace(concat(p_name, '_', p_type, '&50%'), '_', '!_'), '&', '!&'), '%', '!%') AS escaped FROM {part}""",
)
plan.sql("f21_symmetric_relation", "lineitem", """SELECT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y, count(*) AS n FROM {lineitem} GROUP BY 1, 2""")
SCALES = {"g": "1/1000", "kg": "1"}
#: Answers under five contracts, with texts that are right, wrong, and no answer at all.
_GRADED = """(SELECT o_orderkey, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'choice' WHEN '2' THEN 'choice_set' WHEN '3' THEN 'exact' WHEN '4' THEN 'quantity' ELSE 'human' END AS kind, o_orderstatus AS s, o_custkey%7 AS c,
  CASE substr(o_orderpriority,1,1) WHEN '2' THEN 'F,O' WHEN '4' THEN concat(o_custkey%7, ' kg') ELSE 'O' END AS accepted, CASE o_custkey%11 WHEN 0 THEN 'no answer' WHEN 1 THEN '{"answer":null}' ELSE concat('{"answer":', CASE substr(o_orderpriority,1,1)
  WHEN '2' THEN concat('["', o_orderstatus, '"," F","', CASE WHEN o_custkey%7<2 THEN 'O' ELSE 'F ' END, '"', CASE WHEN o_custkey%7=6 THEN ',1' ELSE '' END, ']') WHEN '4' THEN concat('"', CASE WHEN o_orderstatus='F' THEN concat(o_custkey%7, '000 g') ELSE '2 kg' END, '"') ELSE concat('" ', o_orderstatus, ' "') END, '}') END AS response FROM orders) x"""


def f22_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.load(spark, sf_dir, "orders").createOrReplaceTempView(name := f"plumbline_{uuid.uuid4().hex}")
    x = spark.sql(f"SELECT * FROM {_GRADED.replace('FROM orders', f'FROM {name}')}")  # resolved now, so the name can go
    spark.catalog.dropTempView(name)
    answer = grading.answer_of(F.col("response"))
    same = strict_json.quantity_equal(SCALES, "0")(variants.text(answer), F.col("accepted"))
    return x.select("o_orderkey", grading.grade(F.col("kind"), answer, F.split("accepted", ","), same).alias("grade"))


plan.add(
    "f22_grade", f22_grade, "orders",
    f"""SELECT o_orderkey, CASE WHEN kind='human' THEN NULL WHEN NOT json_valid(response) OR json_extract(response,'$.answer') IS NULL OR json_type(response,'$.answer')='NULL' THEN 0
  WHEN kind='choice_set' THEN CAST(list_sort(list_distinct(list_transform(json_extract_string(response,'$.answer[*]'), lambda v: trim(v))))=['F','O'] AND c<>6 AS INT)
  WHEN kind='quantity' THEN CAST(CASE WHEN s='F' THEN true ELSE c=2 END AS INT) ELSE CAST(trim(json_extract_string(response,'$.answer'))='O' AS INT) END AS grade FROM {_GRADED}""",
)
plan.sql(
    "f23_judge", "events",
    """SELECT event_id, CASE WHEN event_type='error' THEN NULL WHEN regexp_like(props, '^."k": [0-9]+.$') THEN CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 50 THEN 1 ELSE 0 END END AS verdict FROM {events}""",
    """SELECT event_id, CASE WHEN event_type='error' THEN NULL WHEN regexp_full_match(props, '."k": [0-9]+.') THEN CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 50 THEN 1 ELSE 0 END END AS verdict FROM events""",
)
plan.sql("f24_reference_contract", "orders", """SELECT CASE WHEN p IN ('1','2') THEN 'choice' WHEN p='3' THEN 'choice_set' ELSE 'human' END AS kind, count(*) AS n FROM (SELECT substr(o_orderpriority,1,1) AS p FROM {orders}) x GROUP BY 1""")
plan.sql("f50_sha256", "documents", "SELECT doc_id, sha2(text, 256) AS h FROM {documents}", "SELECT doc_id, sha256(text) AS h FROM documents")
plan.sql("f51_prefixed_id", "part", "SELECT p_partkey, concat('PAI-', sha2(concat(p_brand, ':', p_type), 256)) AS cid FROM {part}", "SELECT p_partkey, 'PAI-'||sha256(concat(p_brand, ':', p_type)) AS cid FROM part")


def f11_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every benchmark passage in every document."""
    quotes = tables.load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quote_spans(tables.load(spark, sf_dir, "documents"), quotes, "doc_id", "item_id")


plan.add(
    "f11_spans", f11_spans, "",
    """WITH RECURSIVE m AS (SELECT doc_id, item_id, d.text AS t, b.text AS q, instr(d.text, b.text) AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  UNION ALL SELECT doc_id, item_id, t, q, p+length(q)-1+instr(substr(t, p+length(q)), q) FROM m WHERE instr(substr(t, p+length(q)), q)>0)
SELECT doc_id, item_id, CAST(p-1 AS BIGINT) AS start, CAST(p-1+length(q) AS BIGINT) AS "end" FROM m""",
)
plan.sql(
    "f13_availability", "documents",
    r"""SELECT doc_id, CASE WHEN regexp_like(lower(text), '(^|[^a-z])license([^a-z]|$)') THEN 'verbatim' WHEN instr(lower(text), 'licens')>0 THEN 'components' ELSE 'not_found' END AS availability FROM {documents}""",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])license([^a-z]|$)') THEN 'verbatim' WHEN instr(lower(text), 'licens')>0 THEN 'components' ELSE 'not_found' END AS availability FROM documents""",
)
plan.sql(
    "a44_numeric_literals", "documents",
    r"""SELECT doc_id, size(array_distinct(regexp_extract_all(text, '[0-9]+', 0))) AS n FROM {documents}""",
    r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS INT) AS n FROM documents""",
)
plan.sql("p02_first_user_message", "conversations", """SELECT conv_id, min(turn) AS turn, min_by(text, turn) AS text FROM {conversations} WHERE role='user' AND trim(text)<>'' GROUP BY conv_id""")
plan.sql("p07_eligibility", "probes", """SELECT joint_eligible, packet_nonempty, paired, count(*) AS n FROM {probes} GROUP BY 1,2,3""")
plan.sql("p09_reservation", "probes", """SELECT count(*) AS n FROM (SELECT problem_id, cluster_id FROM {probes} WHERE cluster_id%13=0 AND problem_id%2=0) d JOIN (SELECT DISTINCT cluster_id FROM {probes} WHERE problem_id%2=1) t ON d.cluster_id=t.cluster_id""")
plan.sql("p10_release_selection", "reviews", """SELECT mother, min(CASE WHEN status='approved' THEN 1 ELSE 0 END)=1 AS complete, count(*) AS n FROM {reviews} GROUP BY mother""")
plan.sql("p18_status_filter", "reviews", """SELECT mother, status, count(*) AS n FROM {reviews} WHERE lower(mother) LIKE '%src1%' GROUP BY mother, status""")
plan.sql(
    "w02_neutral_alias", "part",
    """SELECT p_brand AS qid, p_partkey AS target, concat('E', row_number() OVER (PARTITION BY p_brand ORDER BY sha2(concat('a:', p_partkey), 256))) AS alias, row_number() OVER (PARTITION BY p_brand ORDER BY sha2(concat('b:', p_partkey), 256)) AS display_pos FROM {part}""",
    """SELECT p_brand AS qid, p_partkey AS target, 'E'||row_number() OVER (PARTITION BY p_brand ORDER BY sha256('a:'||p_partkey)) AS alias, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('b:'||p_partkey)) AS display_pos FROM part""",
)
plan.sql(
    "w03_renumber", "probes",
    """SELECT probe_id AS old_id, format_string('v%03d', row_number() OVER (PARTITION BY problem_id ORDER BY probe_id)) AS new_id FROM {probes} WHERE probe_type<>'N'""",
    """SELECT probe_id AS old_id, printf('v%03d', row_number() OVER (PARTITION BY problem_id ORDER BY probe_id)) AS new_id FROM {probes} WHERE probe_type<>'N'""",
)
plan.sql("w04_contiguous", "attempts", """SELECT request_id, max(attempt)=count(*)-1 AND min(attempt)=0 AS ok FROM {attempts} GROUP BY request_id""")
plan.sql("w05_order", "attempts", """SELECT request_id, count(CASE WHEN ts<prev THEN 1 END)=0 AS ok FROM (SELECT request_id, ts, lag(ts) OVER (PARTITION BY request_id ORDER BY attempt) AS prev FROM {attempts}) x GROUP BY request_id""")
plan.sql(
    "w07_journal_fold", "attempts",
    """WITH f AS (SELECT request_id, count(*) AS attempt_count, min(CASE WHEN kind='completed' THEN attempt END) AS done, min(CASE WHEN kind='nonretryable' THEN attempt END) AS dead, max_by(kind, attempt) AS last_kind FROM {attempts} WHERE attempt<3 GROUP BY request_id)
SELECT request_id, attempt_count, CASE WHEN done IS NOT NULL AND (dead IS NULL OR done<dead) THEN 'completed' ELSE 'infrastructure_missing' END AS status,
  CASE WHEN done IS NOT NULL AND (dead IS NULL OR done<dead) THEN NULL WHEN dead IS NOT NULL THEN 'final_error' WHEN last_kind='started' THEN 'interrupted_request_unknown_response' ELSE 'retries_exhausted' END AS reason FROM f""",
)
plan.sql("t03_status_counts", "attempts", """SELECT kind, count(*) AS n, count(DISTINCT request_id) AS requests FROM {attempts} GROUP BY kind""")
plan.sql("a33_status_matrix", "attempts", """SELECT user_id%10 AS bucket, count(CASE WHEN kind='completed' THEN 1 END) AS completed, count(CASE WHEN kind='retryable' THEN 1 END) AS retryable, count(CASE WHEN kind='nonretryable' THEN 1 END) AS nonretryable, count(CASE WHEN kind='started' THEN 1 END) AS started FROM {attempts} GROUP BY 1""")
plan.sql("a40_service", "probes", """SELECT interface, count(*) AS planned, count(b_raw) AS completed, count(*)-count(b_raw) AS infrastructure_missing FROM {probes} GROUP BY interface""")
plan.sql("a31_vocabulary", "part", """SELECT p_type, count(*) AS n, min(p_partkey) AS first_example FROM {part} GROUP BY p_type""")
plan.sql("a32_state_counts", "reviews", """SELECT status, severity, count(*) AS n FROM {reviews} GROUP BY status, severity""")
plan.sql("w08_blind_first", "probes", """SELECT problem_id, min_by(probe_id, sha2(CAST(probe_id AS STRING), 256)) AS probe_id FROM {probes} GROUP BY problem_id""", """SELECT problem_id, arg_min(probe_id, sha256(CAST(probe_id AS VARCHAR))) AS probe_id FROM {probes} GROUP BY problem_id""")
plan.sql(
    "w10_islands", "attempts",
    """WITH h AS (SELECT DISTINCT datediff(to_date(ts), date'1970-01-01')*24+hour(ts) AS h, user_id%20 AS u FROM {attempts}), g AS (SELECT u, h, h-row_number() OVER (PARTITION BY u ORDER BY h) AS island FROM h) SELECT u, min(h) AS first_hour, max(h) AS last_hour, count(*) AS hours FROM g GROUP BY u, island""",
    """WITH h AS (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT)//3600 AS h, user_id%20 AS u FROM {attempts}), g AS (SELECT u, h, h-row_number() OVER (PARTITION BY u ORDER BY h) AS island FROM h) SELECT u, min(h) AS first_hour, max(h) AS last_hour, count(*) AS hours FROM g GROUP BY u, island""",
)
plan.sql(
    "o07_counterbalance", "probes",
    """SELECT cohort, condition, count(*) AS n FROM (SELECT cohort, CASE WHEN (conv(substr(sha2(CAST(probe_id AS STRING),256),64,1),16,10)+cohort)%2=0 THEN 'raw' ELSE 'gold' END AS condition FROM {probes} CROSS JOIN (VALUES (0),(1)) AS c(cohort)) x GROUP BY 1,2""",
    """SELECT cohort, condition, count(*) AS n FROM (SELECT cohort, CASE WHEN (('0x'||substr(sha256(CAST(probe_id AS VARCHAR)),64,1))::BIGINT+cohort)%2=0 THEN 'raw' ELSE 'gold' END AS condition FROM {probes} CROSS JOIN (VALUES (0),(1)) AS c(cohort)) x GROUP BY 1,2""",
)
plan.sql("o03_worst_requests", "documents", """SELECT doc_id, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 3""")
plan.sql("o04_hash_sample", "orders", """SELECT o_orderkey FROM {orders} ORDER BY sha2(concat('7:', o_orderkey), 256) LIMIT 100""", """SELECT o_orderkey FROM orders ORDER BY sha256('7:'||o_orderkey) LIMIT 100""")
_tokens = "[A-Za-z0-9]+|[^A-Za-z0-9 ]"
plan.sql(
    "h21_token_budget", "documents",
    f"""SELECT lang, max(n) AS worst, max_by(doc_id, struct(n, -doc_id)) AS worst_doc, count(CASE WHEN n<=1500 AND n+500<=1900 THEN 1 END) AS within, min(CASE WHEN n<=1500 AND n+500<=1900 THEN 1 ELSE 0 END)=1 AS ok
FROM (SELECT lang, doc_id, CAST(size(regexp_extract_all(text, '{_tokens}', 0)) AS BIGINT) AS n FROM {{documents}}) x GROUP BY lang""",
    f"""SELECT lang, max(n) AS worst, (list(doc_id ORDER BY n DESC, doc_id))[1] AS worst_doc, count(CASE WHEN n<=1500 AND n+500<=1900 THEN 1 END) AS within, min(CASE WHEN n<=1500 AND n+500<=1900 THEN 1 ELSE 0 END)=1 AS ok
FROM (SELECT lang, doc_id, CAST(len(regexp_extract_all(text, '{_tokens}')) AS BIGINT) AS n FROM documents) x GROUP BY lang""",
)

# Geometry
#: Searches: every box whose number is divisible by 20 asks all boxes.
ASKING = "idx % 20 = 0"
_edge = "CAST(power(greatest(b.x0-a.x1, a.x0-b.x1, 0),2)+power(greatest(b.y0-a.y1, a.y0-b.y1, 0),2) AS BIGINT)"
_centre = "CAST(power(greatest(2*b.x0-a.x0-a.x1, a.x0+a.x1-2*b.x1, 0),2)+power(greatest(2*b.y0-a.y0-a.y1, a.y0+a.y1-2*b.y1, 0),2) AS BIGINT)"
_near = f"(SELECT a.image, a.idx AS anchor, b.idx AS idx, b.alias AS alias, {{}} AS d FROM {{{{boxes}}}} a JOIN {{{{boxes}}}} b ON a.image=b.image AND a.idx<>b.idx WHERE a.{ASKING}) x"


def f30_bbox_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.within(tables.boxes(spark, sf_dir))


plan.add("f30_bbox_distance", f30_bbox_distance, "boxes", f"SELECT a.image, a.idx AS a, b.idx AS b, {_edge} AS d2 FROM {{boxes}} a JOIN {{boxes}} b ON a.image=b.image AND a.idx<>b.idx")


def j09_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return nearest.nearest(b.where(ASKING), b, nearest.squared).select("image", "anchor", F.col("d").alias("d2"), "alias")


def j10_nearest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return nearest.nearest(b.where(ASKING), b, nearest.squared_from_centre, 4).select("image", "anchor", F.col("d").alias("d4"), "ties", F.col("idx").alias("first_idx"))


plan.add("j09_nearest", j09_nearest, "boxes", f"SELECT image, anchor, d AS d2, alias FROM (SELECT *, row_number() OVER (PARTITION BY image, anchor ORDER BY d, idx) AS rn FROM {_near.format(_edge).replace('{{', '{').replace('}}', '}')}) y WHERE rn=1")
plan.add("j10_nearest_ties", j10_nearest_ties, "boxes", f"SELECT image, anchor, d AS d4, count(*) AS ties, min(idx) AS first_idx FROM (SELECT *, min(d) OVER (PARTITION BY image, anchor) AS best FROM {_near.format(_centre).replace('{{', '{').replace('}}', '}')}) y WHERE d=best GROUP BY 1,2,3")
_band = "CASE WHEN d IS NULL THEN 'not_applicable' WHEN d=0 THEN '0' WHEN d<=100 THEN '(0,10]' WHEN d<=2500 THEN '(10,50]' ELSE '(50,inf)' END"


def p25_distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far searching boxes are from the nearest larger box of their image, in bands; some images have none that is larger."""
    b = tables.boxes(spark, sf_dir)
    large = b.where("x1 - x0 >= 50")
    found = nearest.nearest(b.where(ASKING), large, nearest.squared).select("image", F.col("anchor").alias("idx"), "d")
    return b.where(ASKING).join(found, ["image", "idx"], "left").groupBy(F.expr(_band).alias("band")).agg(F.count(F.lit(1)).alias("n"))


plan.add(
    "p25_distance_band", p25_distance_band, "boxes",
    f"""SELECT {_band} AS band, count(*) AS n FROM (SELECT a.idx, (SELECT min({_edge}) FROM {{boxes}} b WHERE b.image=a.image AND b.idx<>a.idx AND b.x1-b.x0>=50) AS d FROM {{boxes}} a WHERE a.{ASKING}) x GROUP BY 1""",
)
plan.sql("f32_geometry", "boxes", """SELECT idx, x0>=0 AND y0>=0 AND x1<=1000 AND y1<=1000 AND x0<x1 AND y0<y1 AS valid FROM {boxes}""")
plan.sql(
    "f36_roundtrip", "boxes",
    """SELECT idx, CAST(bround(CAST(x0 AS DOUBLE)*640/1000) AS BIGINT) AS px, CAST(bround(bround(CAST(x0 AS DOUBLE)*640/1000)*1000/640) AS BIGINT) AS back FROM {boxes}""",
    """SELECT idx, CAST(round_even(CAST(x0 AS DOUBLE)*640/1000,0) AS BIGINT) AS px, CAST(round_even(round_even(CAST(x0 AS DOUBLE)*640/1000,0)*1000/640,0) AS BIGINT) AS back FROM {boxes}""",
)
plan.sql(
    "f37_panel_repair", "boxes",
    """WITH f AS (SELECT image, idx, y0, x0, x1, y1, CASE WHEN x1-x0>y1-y0 THEN 1 ELSE 0 END AS wide FROM {boxes}) SELECT image, idx, CASE WHEN avg(wide) OVER (PARTITION BY image)>=0.6 AND count(*) OVER (PARTITION BY image)>=3 THEN 'refused' WHEN y1=y0 THEN 'dropped' WHEN wide=1 THEN 'swapped' ELSE 'kept' END AS state FROM f""",
)
plan.sql("p21_panel_membership", "boxes", """SELECT idx, CASE WHEN cy>=1500 THEN 3 WHEN cy>=1000 THEN 2 WHEN cy>=500 THEN 1 ELSE 0 END AS panel FROM (SELECT idx, y0+y1 AS cy FROM {boxes}) x""")

# Joins and set operations
plan.sql(
    "j01_pairing_check", "probes",
    """SELECT probe_type, CASE WHEN r.probe_id IS NULL THEN 'gold_without_raw' WHEN g.probe_id IS NULL THEN 'raw_without_gold' ELSE 'paired' END AS state, count(*) AS n
FROM (SELECT probe_id, probe_type FROM {probes} WHERE b_gold IS NOT NULL) g FULL OUTER JOIN (SELECT probe_id, probe_type FROM {probes} WHERE b_raw IS NOT NULL) r USING (probe_id, probe_type) GROUP BY 1, 2""",
)
plan.sql("j03_requests_results", "probes attempts", """SELECT p.probe_id, coalesce(a.kind,'pending') AS status FROM (SELECT probe_id FROM {probes} WHERE probe_type='R') p LEFT JOIN (SELECT request_id, max_by(kind, attempt) AS kind FROM {attempts} GROUP BY request_id) a ON p.probe_id=a.request_id""")
plan.sql("j05_semi", "probes answers", """SELECT count(*) AS n FROM {probes} p WHERE EXISTS (SELECT 1 FROM {answers} a WHERE a.problem_id=p.problem_id AND a.answer IS NOT NULL)""")
plan.sql("j12_unresolved", "lineitem part", """SELECT CAST(l_partkey+50 AS BIGINT) AS ref, count(*) AS n FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey=l.l_partkey+50) GROUP BY 1""")
plan.sql("j13_unique_match", "documents", """SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha2(text,256)) AS n FROM {documents}) x WHERE n=1""", """SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) x WHERE n=1""")
plan.sql("j15_integrity", "documents labels", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'ok' END AS state FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id=l.doc_id""")
plan.sql("j19_signature_match", "lineitem", """WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM {lineitem}) SELECT a.l_orderkey, a.l_linenumber, count(*) AS occurrences FROM s a JOIN s b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber=b.l_linenumber AND a.rn=b.rn GROUP BY 1,2""")
plan.sql("j23_dimensions", "nation region customer", """SELECT r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal),4) AS balance FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey GROUP BY 1,2""")
plan.sql("u01_union", "customer supplier", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
plan.sql("u02_intersect", "customer supplier", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
plan.sql("u03_except", "orders lineitem", "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem} WHERE l_returnflag='R'")
plan.sql("u04_set_equality", "orders lineitem", "SELECT count(*) AS differing FROM ((SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}) UNION ALL (SELECT l_orderkey FROM {lineitem} EXCEPT SELECT o_orderkey FROM {orders})) x")
plan.sql("u05_subset", "labels documents", "SELECT count(*) AS outside FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents}) x")
plan.sql("u06_disjoint", "probes", "SELECT count(*) AS shared FROM (SELECT cluster_id FROM {probes} WHERE problem_id%2=0 INTERSECT SELECT cluster_id FROM {probes} WHERE problem_id%2=1) x")
plan.sql("u07_multiset_difference", "lineitem", "SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag='A' EXCEPT ALL SELECT l_partkey FROM {lineitem} WHERE l_returnflag='R'")
plan.sql(
    "u08_set_f1", "lineitem",
    """WITH s AS (SELECT l_orderkey, collect_set(l_partkey%5) AS a, collect_set(l_suppkey%5) AS b FROM {lineitem} GROUP BY 1) SELECT l_orderkey, round(CAST(2*size(array_intersect(a,b)) AS DOUBLE)/(size(a)+size(b)),9) AS f1, array_sort(a)=array_sort(b) AS equal FROM s""",
    """WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey%5)) AS a, list_distinct(list(l_suppkey%5)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, round(CAST(2*len(list_intersect(a,b)) AS DOUBLE)/(len(a)+len(b)),9) AS f1, list_sort(a)=list_sort(b) AS equal FROM s""",
)

# Identity, components, audit


def a23_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content groups and their least ids; an id that comes with several contents blocks every group it is in.

    Each document is a record, and every tenth comes a second time with another text.
    """
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    records = docs.unionByName(docs.where("doc_id % 10 = 3").select("doc_id", F.concat("text", F.lit("!")).alias("text"))).select("doc_id", F.sha2("text", 256).alias("h"))
    conflicts = records.groupBy("doc_id").agg((F.countDistinct("h") > 1).alias("conflict"))
    met = records.join(conflicts, "doc_id")
    groups = met.groupBy("h").agg(F.min("doc_id").alias("representative_id"), F.bool_or("conflict").alias("blocked"))
    state = F.when(F.col("blocked"), "blocked").when(F.col("doc_id") == F.col("representative_id"), "representative").otherwise("duplicate")
    return records.join(groups, "h").select("doc_id", F.concat(F.lit("DG-"), "h").alias("dedup_group"), "representative_id", state.alias("state"))


plan.add(
    "a23_dedup", a23_dedup, "",
    """WITH x AS (SELECT doc_id, sha256(coalesce(text,'')) AS h FROM documents UNION ALL SELECT doc_id, sha256(coalesce(text,'')||'!') FROM documents WHERE doc_id%10=3)
SELECT doc_id, 'DG-'||h AS dedup_group, min(doc_id) OVER (PARTITION BY h) AS representative_id, CASE WHEN max(CAST(doc_id%10=3 AS INT)) OVER (PARTITION BY h)=1 THEN 'blocked' WHEN doc_id=min(doc_id) OVER (PARTITION BY h) THEN 'representative' ELSE 'duplicate' END AS state FROM x""",
)
_duck_edges = tables.SQL["edges"]
_reach = f"WITH RECURSIVE {_duck_edges}, eb AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), rc AS (SELECT a AS node, a AS other FROM eb UNION SELECT rc.node, e.b FROM rc JOIN eb e ON rc.other=e.a), cc AS (SELECT node, min(other) AS component FROM rc GROUP BY node)"
plan.add("a24_components", lambda s, d: connected_components(tables.edges(s, d)), "", _reach + " SELECT node, component FROM cc")


def a26_component_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bad member blocks its whole component: closure first, filter after."""
    cc = connected_components(tables.edges(spark, sf_dir))
    reason = F.when(F.col("node") % 5 == 0, "multiple_of_five").when(F.col("node") % 7 == 0, "multiple_of_seven")
    return cc.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons")).select("component", "n", F.when(F.col("reasons") == "", "ok").otherwise("blocked").alias("state"), "reasons")


plan.add(
    "a26_component_block", a26_component_block, "",
    _reach + ", r AS (SELECT component, CASE WHEN node%5=0 THEN 'multiple_of_five' WHEN node%7=0 THEN 'multiple_of_seven' END AS reason FROM cc) SELECT component, count(*) AS n, CASE WHEN count(reason)=0 THEN 'ok' ELSE 'blocked' END AS state, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason),'') AS reasons FROM r GROUP BY component",
)
plan.sql("a34_review_summary", "reviews", """SELECT mother, count(*) AS probes, min(CASE WHEN status='approved' THEN 1 ELSE 0 END)=1 AS approved, count(CASE WHEN severity='serious' THEN 1 END) AS serious, count(CASE WHEN severity='minor' THEN 1 END) AS minor FROM {reviews} GROUP BY mother""")


def a35_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled items per mother and the exact upper bound on serious defects among all of them."""
    r = tables.reviews(spark, sf_dir)
    serious = F.count(F.when((F.col("probe") % 2 == 0) & (F.col("severity") == "serious"), 1))
    g = r.groupBy("mother").agg(F.count(F.lit(1)).alias("population"), F.count(F.when(F.col("probe") % 2 == 0, 1)).alias("sample"), serious.alias("found"))
    return g.withColumn("upper_bound", audit.upper_bound("population", "sample", "found")).withColumn("passes", F.col("upper_bound") * 20 <= F.col("population"))


plan.add("a35_audit", a35_audit)  # binomials beyond SQL's numbers; tests hold it against literal values
plan.sql("v16_split_integrity", "probes", """SELECT cluster_id, count(DISTINCT problem_id%2) AS splits, count(DISTINCT problem_id) AS problems FROM {probes} GROUP BY cluster_id HAVING count(DISTINCT problem_id%2)>1""")
plan.sql("v17_review_conflicts", "reviews", """SELECT probe, 'error' AS level, 'approved_with_serious' AS code FROM {reviews} WHERE status='approved' AND severity='serious'""")
plan.sql("v07_duplicate_keys", "lineitem", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1,2 HAVING count(*)>1""")
plan.sql("v03_missing_parents", "nation region", """SELECT n_nationkey AS id, 'error' AS level, 'unknown_region' AS code FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {region} WHERE r_regionkey=n_regionkey+1)""")
plan.sql("h51_oscillation", "attempts", """SELECT request_id, attempt, count(*) OVER (PARTITION BY request_id, kind ORDER BY attempt)>1 AS seen_before FROM {attempts}""")
plan.sql("h54_usage", "attempts", """SELECT kind AS phase, count(*) AS calls, CAST(sum(attempt) AS BIGINT) AS retries FROM {attempts} GROUP BY kind""")
plan.sql("h43_mother_probes", "reviews", """SELECT mother, array_join(transform(array_sort(collect_list(probe)), x -> cast(x as string)), ',') AS probes FROM {reviews} GROUP BY mother""", """SELECT mother, string_agg(CAST(probe AS VARCHAR), ',' ORDER BY probe) AS probes FROM {reviews} GROUP BY mother""")

QUERIES, ORACLES = plan.queries, plan.oracles
