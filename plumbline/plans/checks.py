"""Validators that give issue rows, and the lookups, overlays and gates around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import strict_json
from plumbline.sources import shared

from .base import Plan, frames

plan = Plan()


def add(name: str, relations: str, query, duck: str) -> None:
    """A query over shared relations."""
    plan.queries[name] = lambda spark, d: query(*(shared.relation(spark, d, n) for n in relations.split()))
    plan.oracles[name] = shared.duck(relations, duck)


def derived(name: str, relations: str, query, duck: str) -> None:
    """A query over tables and the relations of ``sources.tables``."""
    plan.add(name, lambda spark, d: query(*frames(spark, d, relations).values()), relations, duck)


def issues(df: DataFrame, key: str, **codes) -> DataFrame:
    """(key, level, code): one row for each condition that holds; a condition that is unknown does not."""
    found = F.filter(F.array(*(F.when(c, F.lit(code)) for code, c in codes.items())), lambda x: x.isNotNull())
    return df.select(key, F.lit("error").alias("level"), F.explode(found).alias("code"))


def _union(relation: str, key: str, **codes) -> str:
    return " UNION ALL ".join(f"SELECT {key}, 'error' AS level, '{code}' AS code FROM {relation} WHERE {c}" for code, c in codes.items())


# Geometry and documents

derived(
    "f38_geometry_issues", "boxes",
    lambda b: issues(
        b, "idx", out_of_range=~(F.col("x1").between(0, 930) & F.col("y1").between(0, 930)), degenerate=(F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")),
        centre_outside=(F.col("idx") * 37 % 900 + 20 > F.col("x1")),
    ),
    _union("{boxes}", "idx", out_of_range="x1>930 OR y1>930", degenerate="x1<=x0 OR y1<=y0", centre_outside="x0+20>x1"),
)
derived(
    "f34_circle_points", "boxes",
    lambda b: b.select("idx", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((F.col("x1") - F.col("x0")) / 2).alias("r"), (F.col("x1") - F.col("x0")).alias("a"), (F.col("y1") - F.col("y0")).alias("d")).select(
        # The affine map (a 2 3; 2 d 5), whose determinant is 0 for some boxes: these give no points.
        "idx", (F.abs(F.col("a") * F.col("d") - 4.0) < 1e-12).alias("singular"), "a", "d",
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct((F.col("cx") + F.col("r") * F.cos(k * 3.141592653589793 / 16)).alias("x"), (F.col("cy") + F.col("r") * F.sin(k * 3.141592653589793 / 16)).alias("y"))).alias("p"),
    ).select(
        "idx", "singular", F.when(~F.col("singular"), F.round(F.array_max(F.transform("p", lambda q: F.col("a") * q["x"] + 2 * q["y"] + 3)), 6)).alias("max_x"),
        F.when(~F.col("singular"), F.round(F.aggregate("p", F.lit(0.0), lambda s, q: s + 2 * q["x"] + F.col("d") * q["y"] + 5) / 32, 6)).alias("mean_y"),
    ),
    """WITH k AS (SELECT idx, x1-x0 AS a, y1-y0 AS d, (x0+x1)/2.0 AS cx, (y0+y1)/2.0 AS cy, (x1-x0)/2.0 AS r, unnest(range(32)) AS k FROM {boxes})
SELECT idx, a*d=4 AS singular, CASE WHEN a*d<>4 THEN round(max(a*(cx+r*cos(k*pi()/16))+2*(cy+r*sin(k*pi()/16))+3),6) END AS max_x, CASE WHEN a*d<>4 THEN round(avg(2*(cx+r*cos(k*pi()/16))+d*(cy+r*sin(k*pi()/16))+5),6) END AS mean_y FROM k GROUP BY idx, a, d""",
)
derived(
    "f35_render_coverage", "boxes",
    lambda b: b.where("idx % 17 <> 0").select("idx", F.col("x0").cast("double").alias("want")).join(
        b.where("idx % 19 <> 0").select("idx", (F.col("x0") + F.when(F.col("idx") % 5 == 0, 1e-3).when(F.col("idx") % 5 == 1, 5e-7).otherwise(0.0)).alias("got")), "idx", "full_outer"
    ).select("idx", F.when(F.col("want").isNull(), "unexpected").when(F.col("got").isNull(), "missing").when(F.abs(F.col("want") - F.col("got")) > 1e-6, "moved").otherwise("ok").alias("code")),
    "SELECT idx, CASE WHEN idx%17=0 THEN 'unexpected' WHEN idx%19=0 THEN 'missing' WHEN idx%5=0 THEN 'moved' ELSE 'ok' END AS code FROM {boxes} WHERE idx%17<>0 OR idx%19<>0",
)


def v01_document_issues(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Repeated keys, references to nothing and empty fields of a document's rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = items.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.when(F.col("l_suppkey") % 10 == 0, 10**9).otherwise(0)).alias("ref"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("kind"), n.alias("n"))
    known = rows.join(parts.select(F.col("p_partkey").alias("ref"), F.lit(True).alias("known")), "ref", "left")
    out = issues(known.withColumn("document", F.col("l_orderkey")), "document", duplicate_id=F.col("n") > 1, unknown_reference=F.col("known").isNull(), empty_field=F.col("kind") == "")
    return out.groupBy("document", "code").agg(F.count(F.lit(1)).alias("n"))


derived(
    "v01_document_issues", "lineitem part", v01_document_issues,
    """SELECT l_orderkey AS document, 'duplicate_id' AS code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*)>1) x GROUP BY 1
UNION ALL SELECT l_orderkey, 'unknown_reference', count(*) FROM {lineitem} WHERE l_suppkey%10=0 OR l_partkey NOT IN (SELECT p_partkey FROM {part}) GROUP BY 1 UNION ALL SELECT l_orderkey, 'empty_field', count(*) FROM {lineitem} WHERE l_returnflag='N' GROUP BY 1""",
)


def v05_binding_types(items: DataFrame) -> DataFrame:
    """Bindings whose ends are of kinds that their type doesn't join: labels goes from a label to a node, refers_to to an entity."""
    ends = items.select("l_orderkey", F.expr("CASE l_returnflag WHEN 'A' THEN 'labels' WHEN 'R' THEN 'refers_to' ELSE 'same_entity_as' END").alias("type"), F.expr("element_at(array('label','node','entity'), CAST(l_partkey%3+1 AS INT))").alias("a"), F.expr("element_at(array('label','node','entity'), CAST(l_suppkey%3+1 AS INT))").alias("b"))
    allowed = items.sparkSession.createDataFrame([("labels", "label", "node"), ("labels", "label", "entity"), ("refers_to", "label", "entity"), ("refers_to", "node", "entity"), ("same_entity_as", "entity", "entity")], "type string, a string, b string")
    turned = allowed.select("type", F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("turned")).where("a <> b")
    met = ends.join(F.broadcast(allowed.withColumn("fits", F.lit(True))), ["type", "a", "b"], "left").join(F.broadcast(turned), ["type", "a", "b"], "left")
    return met.groupBy("type", F.when(F.col("fits"), "ok").when(F.col("turned"), "wrong_direction").otherwise("wrong_kinds").alias("code")).agg(F.count(F.lit(1)).alias("n"))


derived(
    "v05_binding_types", "lineitem", v05_binding_types,
    """SELECT CASE l_returnflag WHEN 'A' THEN 'labels' WHEN 'R' THEN 'refers_to' ELSE 'same_entity_as' END AS type,
  CASE WHEN l_returnflag='A' AND p=0 AND s>0 OR l_returnflag='R' AND p<2 AND s=2 OR l_returnflag='N' AND p=2 AND s=2 THEN 'ok' WHEN l_returnflag='A' AND s=0 AND p>0 OR l_returnflag='R' AND s<2 AND p=2 THEN 'wrong_direction' ELSE 'wrong_kinds' END AS code, count(*) AS n
FROM (SELECT l_returnflag, l_partkey%3 AS p, l_suppkey%3 AS s FROM {lineitem}) x GROUP BY 1,2""",
)
derived(
    "v08_evidence_repair", "lineitem",
    lambda i: i.groupBy("l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("n_visual"), F.max(F.col("l_linestatus") == "O").alias("claims")).select(
        "l_orderkey", F.when(F.col("claims") & (F.col("n_visual") == 0), "claim_without_evidence").when(~F.col("claims") & (F.col("n_visual") > 0), "evidence_without_claim").otherwise("ok").alias("code"), (F.col("n_visual") > 0).alias("repaired_claim")
    ),
    """WITH v AS (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_returnflag='A'), c AS (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_linestatus='O')
SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey IN (FROM c) AND l_orderkey NOT IN (FROM v) THEN 'claim_without_evidence' WHEN l_orderkey IN (FROM v) AND l_orderkey NOT IN (FROM c) THEN 'evidence_without_claim' ELSE 'ok' END AS code, l_orderkey IN (FROM v) AS repaired_claim FROM {lineitem}""",
)


def v11_mention_dedup(c: DataFrame) -> DataFrame:
    """Mentions with one signature (role and first words) in a conversation: if just one is valid it stays for all, else none does."""
    rows = c.where("text is not null").select("conv_id", "turn", "role", F.substring("text", 1, 1).alias("quote"), (F.length("text") > 200).alias("valid"))
    g = rows.groupBy("conv_id", "role", "quote").agg(F.count(F.lit(1)).alias("mentions"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"), F.min(F.when(F.col("valid"), F.col("turn"))).alias("first")).where("mentions > 1")
    return g.select("conv_id", "role", "quote", "mentions", F.when(F.col("n_valid") == 1, F.col("first")).alias("kept"), F.when(F.col("n_valid") == 1, "merged").when(F.col("n_valid") == 0, "none_valid").otherwise("inseparable").alias("state"))


derived(
    "v11_mention_dedup", "conversations", v11_mention_dedup,
    """WITH m AS (SELECT conv_id, role, text[1:1] AS quote, list(turn) FILTER (WHERE length(text)>200) AS valid, count(*) AS mentions FROM {conversations} WHERE text IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>1)
SELECT conv_id, role, quote, mentions, CASE WHEN len(valid)=1 THEN valid[1] END AS kept, CASE WHEN len(valid)=1 THEN 'merged' WHEN coalesce(len(valid),0)=0 THEN 'none_valid' ELSE 'inseparable' END AS state FROM m""",
)


def v12_canonical_ids(b: DataFrame) -> DataFrame:
    """Nodes numbered anew by place, references rewritten with them; what refers to nothing shows as unresolved."""
    order = Window.partitionBy("image").orderBy("y0", "x0", "idx")
    named = b.select("image", "idx", (F.col("idx") + 50).alias("ref"), F.format_string("v%03d", F.row_number().over(order)).alias("new_id"))
    to = named.select("image", F.col("idx").alias("ref"), F.col("new_id").alias("new_ref"))
    return named.join(to, ["image", "ref"], "left").select("image", "idx", "new_id", "new_ref", F.when(F.col("new_ref").isNull(), "unresolved").when(F.col("new_ref") == F.col("new_id"), "self").otherwise("rewritten").alias("audit"))


derived(
    "v12_canonical_ids", "boxes", v12_canonical_ids,
    """WITH n AS (SELECT image, idx, printf('v%03d', row_number() OVER (PARTITION BY image ORDER BY y0, x0, idx)) AS new_id FROM {boxes})
SELECT a.image, a.idx, a.new_id, r.new_id AS new_ref, CASE WHEN r.new_id IS NULL THEN 'unresolved' ELSE 'rewritten' END AS audit FROM n a LEFT JOIN n r ON r.image=a.image AND r.idx=a.idx+50""",
)


def v20_retry_rule(r: DataFrame) -> DataFrame:
    """A revision must drop or change every mother known as bad; a systemic defect asks for a wider sample."""
    bad = r.where("severity = 'serious'").select("mother").distinct()
    revised = r.where("probe % 3 <> 0").groupBy("mother").agg(F.count(F.lit(1)).alias("after"))
    before = r.groupBy("mother").agg(F.count(F.lit(1)).alias("before"), F.count(F.when(F.col("severity") == "serious", 1)).alias("serious"))
    met = bad.join(before, "mother").join(revised, "mother", "left")
    state = F.when(F.col("after").isNull(), "dropped").when(F.col("after") != F.col("before"), "changed").otherwise("unchanged")
    return met.select("mother", state.alias("state"), (F.col("serious") * 10 > F.col("before")).alias("systemic"))


derived(
    "v20_retry_rule", "reviews", v20_retry_rule,
    """SELECT mother, CASE WHEN count(CASE WHEN probe%3<>0 THEN 1 END)=0 THEN 'dropped' WHEN count(CASE WHEN probe%3=0 THEN 1 END)>0 THEN 'changed' ELSE 'unchanged' END AS state, 10*count(CASE WHEN severity='serious' THEN 1 END)>count(*) AS systemic
FROM {reviews} GROUP BY mother HAVING count(CASE WHEN severity='serious' THEN 1 END)>0""",
)
derived(
    "h45_authorisation", "reviews",
    lambda r: r.select("probe", "mother", "status", F.row_number().over(Window.partitionBy("mother").orderBy(F.sha2(F.col("probe").cast("string"), 256))).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("mother")).alias("n")).select(
        "probe", F.when(F.col("status") != "approved", "none").when(F.col("rn") == 1, "individual").when(F.col("rn") * 5 <= F.col("n"), "sampled").otherwise("not_sampled").alias("evidence")
    ),
    """WITH o AS (SELECT mother, list_sort(list(sha256(CAST(probe AS VARCHAR)))) AS hs FROM {reviews} GROUP BY mother)
SELECT probe, CASE WHEN status<>'approved' THEN 'none' WHEN list_position(hs, sha256(CAST(probe AS VARCHAR)))=1 THEN 'individual' WHEN 5*list_position(hs, sha256(CAST(probe AS VARCHAR)))<=len(hs) THEN 'sampled' ELSE 'not_sampled' END AS evidence FROM {reviews} r JOIN o ON o.mother=r.mother""",
)

# Lookups and gates

derived(
    "h01_multiplicity", "customer",
    lambda c: c.select("c_custkey", F.expr("CASE WHEN c_custkey%7=0 THEN NULL WHEN c_custkey%11=0 THEN -1 ELSE c_custkey%3 END").alias("m")).select("c_custkey", F.when(F.col("m").isNull(), 1).when(F.col("m") >= 0, F.col("m")).cast("long").alias("multiplicity"), F.when(F.col("m") < 0, "negative").when(F.col("m").isNull(), "default").otherwise("given").alias("state")),
    "SELECT c_custkey, CASE WHEN c_custkey%7=0 THEN 1 WHEN c_custkey%11<>0 THEN c_custkey%3 END AS multiplicity, CASE WHEN c_custkey%7=0 THEN 'default' WHEN c_custkey%11=0 THEN 'negative' ELSE 'given' END AS state FROM {customer}",
)
derived(
    "h02_score_coverage", "probes",
    lambda p: p.select("probe_id", F.lit(1).alias("planned")).join(p.where("probe_id % 19 <> 0").select((F.col("probe_id") + F.when(F.col("probe_id") % 23 == 0, -(10**12)).otherwise(0)).alias("probe_id"), F.lit(1).alias("scored")), "probe_id", "full_outer").where(
        "planned is null or scored is null"
    ).select("probe_id", F.when(F.col("planned").isNull(), "not_planned").otherwise("not_scored").alias("code")),
    "SELECT probe_id, 'not_scored' AS code FROM {probes} WHERE probe_id%19=0 OR probe_id%23=0 UNION ALL SELECT probe_id-1000000000000, 'not_planned' FROM {probes} WHERE probe_id%23=0 AND probe_id%19<>0",
)
derived("h08_target_ids", "boxes", lambda b: b.select("idx", F.to_json(F.array("image", "alias")).alias("target")), """SELECT idx, concat('["', image, '","', alias, '"]') AS target FROM {boxes}""")


def h09_inventories(p: DataFrame) -> DataFrame:
    """Inventories as a map, a map in ``files`` or a list of path and sha256, in one form; null hashes where the form is none of them."""
    text = F.expr("""CASE p_partkey%4 WHEN 0 THEN concat('{"a',p_partkey,'":"h1","b":"h2"}') WHEN 1 THEN concat('{"files":{"a',p_partkey,'":"h1","b":"h2"}}') WHEN 2 THEN concat('[{"path":"a',p_partkey,'","sha256":"h1"},{"path":"b","sha256":"h2"}]') ELSE '17' END""")
    listed = F.transform(F.from_json("t", "array<struct<path:string,sha256:string>>"), lambda x: F.struct(x["path"].alias("key"), x["sha256"].alias("value")))
    nested = F.map_entries(F.from_json(F.get_json_object("t", "$.files"), "map<string,string>"))
    flat = F.map_entries(F.from_json("t", "map<string,string>"))
    entries = F.when(F.startswith("t", F.lit("[")), listed).when(F.startswith("t", F.lit("{")), F.coalesce(nested, flat))
    return p.select("p_partkey", text.alias("t")).select("p_partkey", F.explode_outer(entries).alias("e")).select("p_partkey", F.col("e.key").alias("path"), F.col("e.value").alias("sha256"))


derived("h09_inventories", "part", h09_inventories, "SELECT p_partkey, 'a'||p_partkey AS path, 'h1' AS sha256 FROM {part} WHERE p_partkey%4<3 UNION ALL SELECT p_partkey, 'b', 'h2' FROM {part} WHERE p_partkey%4<3 UNION ALL SELECT p_partkey, NULL, NULL FROM {part} WHERE p_partkey%4=3")


def _payload():
    return F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))



derived(
    "h11_stored_hashes", "orders",
    lambda o: o.select("o_orderkey", F.sha2(_payload(), 256).alias("now"), F.sha2(F.when(F.col("o_custkey") % 10 == 0, F.concat(_payload(), F.lit(" "))).otherwise(_payload()), 256).alias("stored")).where("now <> stored").select("o_orderkey", F.lit("hash_differs").alias("code")),
    "SELECT o_orderkey, 'hash_differs' AS code FROM {orders} WHERE o_custkey%10=0",
)


def h14_replay(o: DataFrame) -> DataFrame:
    """Responses recorded for the fingerprint of the same request snapshot; a request without one is an error row, never an exception."""
    snapshot = F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256)
    recorded = o.where("o_orderstatus <> 'P'").groupBy(snapshot.alias("fp")).agg(F.min("o_orderkey").alias("response"))
    return o.select("o_orderkey", snapshot.alias("fp")).join(recorded, "fp", "left").select("o_orderkey", "response", F.when(F.col("response").isNull(), "no_recorded_response").otherwise("replayed").alias("state"))


derived(
    "h14_replay_lookup", "orders", h14_replay,
    "SELECT o_orderkey, CASE WHEN o_orderstatus<>'P' THEN min(o_orderkey) OVER (PARTITION BY o_orderpriority, o_orderstatus) END AS response, CASE WHEN o_orderstatus<>'P' THEN 'replayed' ELSE 'no_recorded_response' END AS state FROM {orders}",
)


def h15_answer_key(d: DataFrame, lab: DataFrame) -> DataFrame:
    """Answers for a template: each bound to the input's hash; those that lack, moved on or came twice are issues."""
    key = lab.select("doc_id", "quality").union(lab.where("doc_id % 9 = 0").select("doc_id", "quality"))
    key = key.join(d.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id").withColumn("h", F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("h")))
    got = key.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("bound"), F.max("quality").alias("answer"))
    met = d.select("doc_id", F.sha2("text", 256).alias("h")).join(got, "doc_id", "left")
    return met.select("doc_id", "answer", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("bound") != F.col("h"), "input_changed").otherwise("frozen").alias("state"))


derived(
    "h15_answer_key", "documents labels", h15_answer_key,
    "SELECT d.doc_id, l.quality AS answer, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id%9=0 THEN 'duplicate' WHEN d.doc_id%6=0 THEN 'input_changed' ELSE 'frozen' END AS state FROM {documents} d LEFT JOIN {labels} l ON l.doc_id=d.doc_id",
)
derived(
    "h16_catalog_overlay", "part",
    lambda p: p.select("p_partkey", F.col("p_name").alias("text"), F.sha2("p_name", 256).alias("h")).join(
        p.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("new"), F.sha2(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("")), 256).alias("bound")), "p_partkey", "left"
    ).select("p_partkey", F.when(F.col("bound") == F.col("h"), F.col("new")).otherwise(F.col("text")).alias("text"), F.when(F.col("bound").isNull(), "original").when(F.col("bound") == F.col("h"), "overlaid").otherwise("refused").alias("state")),
    "SELECT p_partkey, CASE WHEN p_partkey%6=0 THEN upper(p_name) ELSE p_name END AS text, CASE WHEN p_partkey%6=0 THEN 'overlaid' WHEN p_partkey%3=0 THEN 'refused' ELSE 'original' END AS state FROM {part}",
)
add(
    "h17_mother_attachments", "attachments",
    lambda a: a.select("mother", "probe", F.array_compact(F.array("first_image", "second_image")).alias("images")).groupBy("mother").agg(F.countDistinct("images").alias("sets"), F.min(F.array_join("images", ",")).alias("images")).select(
        "mother", F.when(F.col("sets") == 1, F.col("images")).alias("images"), F.when(F.col("sets") == 1, "consistent").otherwise("conflict").alias("state")
    ),
    """WITH x AS (SELECT mother, list_sort(list(DISTINCT concat_ws(',', first_image, second_image))) AS sets FROM attachments GROUP BY mother) SELECT mother, CASE WHEN len(sets)=1 THEN sets[1] END AS images, CASE WHEN len(sets)=1 THEN 'consistent' ELSE 'conflict' END AS state FROM x""",
)


def _slots():
    return F.array_compact(F.array("image_1", "image_2", "image_3"))



add("h18_image_slots", "sources", lambda s: s.select("source", F.array_join(_slots(), "|").alias("images"), F.size(_slots()).cast("long").alias("n")), "SELECT source, concat_ws('|', image_1, image_2, image_3) AS images, CAST((image_1 IS NOT NULL)::INT+(image_2 IS NOT NULL)::INT+(image_3 IS NOT NULL)::INT AS BIGINT) AS n FROM sources")
add(
    "h19_reference_fallback", "sources",
    lambda s: s.select("source", strict_json.strict_json("reference").alias("o"), "reference").select("source", F.coalesce(F.get_json_object("o", "$.answer"), F.col("reference")).alias("answer"), F.when(F.col("o").isNull(), "text").otherwise("json").alias("form")),
    "SELECT source, CASE source%4 WHEN 0 THEN segment WHEN 2 THEN CAST(source AS VARCHAR) ELSE reference END AS answer, CASE WHEN source%2=0 THEN 'json' ELSE 'text' END AS form FROM sources",
)
add(
    "h47_media_paths", "sources",
    lambda s: s.select("source", _slots().alias("paths")).select(
        "source", F.exists("paths", lambda x: F.regexp_like(x, F.lit("(^|/)\\.\\.(/|$)|^/"))).alias("escapes"), (F.size(F.array_distinct(F.transform("paths", lambda x: F.lower(x)))) < F.size("paths")).alias("repeats")
    ),
    "SELECT source, coalesce(image_3 LIKE '../%', false) AS escapes, coalesce(lower(image_1)=lower(image_3), false) AS repeats FROM sources",
)
derived(
    "h20_intervals", "runs",
    lambda r: r.groupBy("model").agg(F.round(F.avg("b") - 0.1, 9).alias("lo"), F.round(F.avg("b") + 0.1, 9).alias("hi")).select("model", F.when(F.col("model") == "m1", None).otherwise(F.when(F.col("model") == "m2", F.col("hi")).otherwise(F.col("lo"))).alias("lo"), F.when(F.col("model") != "m1", F.when(F.col("model") == "m2", F.col("lo")).otherwise(F.col("hi"))).alias("hi")).select(
        "model", F.when(F.col("lo").isNull() | F.col("hi").isNull(), "withheld").when(F.col("lo") > F.col("hi"), "invalid").otherwise("ok").alias("state"), F.when(F.col("lo") <= F.col("hi"), F.round(F.col("hi") - F.col("lo"), 6)).alias("width")
    ),
    "SELECT DISTINCT model, CASE model WHEN 'm1' THEN 'withheld' WHEN 'm2' THEN 'invalid' ELSE 'ok' END AS state, CASE WHEN model NOT IN ('m1','m2') THEN 0.2::DOUBLE END AS width FROM {runs}",
)
derived(
    "h23_option_ids", "nation",
    lambda n: n.select("n_nationkey", F.array(*(F.struct(F.when(F.col("n_nationkey") % 2 == k % 2, F.lit(f"id{k}")).alias("id"), F.lit(f"L{k}").alias("label")) for k in range(3))).alias("o")).select("n_nationkey", F.array_join(F.transform("o", lambda x: F.coalesce(x["id"], x["label"])), ",").alias("options")),
    "SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 'id0,L1,id2' ELSE 'L0,id1,L2' END AS options FROM {nation}",
)
derived(
    "h26_selection", "orders customer",
    lambda o, c: o.join(c.where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").orderBy("o_orderkey").limit(50).select("o_orderkey"),
    "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment='BUILDING' AND c_acctbal>5000) ORDER BY o_orderkey LIMIT 50",
)
derived(
    "h28_descriptor_equality", "supplier nation",
    lambda s, n: s.select("s_suppkey", F.col("s_nationkey").alias("a"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")).alias("b"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)).alias("c")).select(
        "s_suppkey", F.col("a").eqNullSafe(F.col("b")).alias("key_equal"), F.col("b").eqNullSafe(F.col("c")).alias("audit_equal")
    ),
    "SELECT s_suppkey, s_suppkey%5<>0 AS key_equal, s_suppkey%5=0 OR s_suppkey%7<>0 AS audit_equal FROM {supplier}",
)


def h29_registry(p: DataFrame) -> DataFrame:
    """Requested registry entries that are not there exactly once."""
    registry = p.groupBy("p_brand").agg(F.countDistinct("p_type").alias("n"))
    wanted = p.select("p_brand").distinct().union(p.select(F.concat("p_brand", F.lit("?"))).distinct())
    return wanted.join(registry, "p_brand", "left").where("n is null or n <> 1").select("p_brand", F.when(F.col("n").isNull(), "not_found").otherwise("ambiguous").alias("code"))


derived("h29_registry", "part", h29_registry, "SELECT p_brand, 'ambiguous' AS code FROM {part} GROUP BY 1 HAVING count(DISTINCT p_type)>1 UNION ALL SELECT DISTINCT p_brand||'?', 'not_found' FROM {part}")
derived(
    "h46_segregation", "reviews",
    lambda r: r.groupBy("mother").agg(F.bool_and(F.col("probe") % 2 == 0).alias("all_real"), F.bool_or(F.col("probe") % 2 == 0).alias("any_real")).select("mother", F.when(F.col("all_real"), "real").when(~F.col("any_real"), "synthetic").otherwise("mixed").alias("state")),
    "SELECT mother, CASE WHEN max(probe%2)=0 THEN 'real' WHEN min(probe%2)=1 THEN 'synthetic' ELSE 'mixed' END AS state FROM {reviews} GROUP BY 1",
)
derived(
    "h53_semantic_inventory", "boxes",
    lambda b: b.where("x1 > x0 and y1 > y0").groupBy("image").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("nodes"), F.count(F.lit(1)).alias("n")),
    "SELECT image, array_to_string(list_sort(list(DISTINCT alias)), ',') AS nodes, count(*) AS n FROM {boxes} WHERE x1>x0 AND y1>y0 GROUP BY 1",
)
derived(
    "h56_visual_signature", "boxes",
    lambda b: _signature(b).join(_signature(b.withColumn("x0", F.col("x0") + 3).withColumn("alias", F.when(F.col("idx") % 40 == 0, "other").otherwise(F.col("alias")))).withColumnRenamed("signature", "after"), "image").select("image", (F.col("signature") == F.col("after")).alias("unchanged")),
    "SELECT image, count(CASE WHEN idx%40=0 THEN 1 END)=0 AS unchanged FROM {boxes} GROUP BY 1",
)


def _signature(b: DataFrame) -> DataFrame:
    """Per image the sorted names and ranks of its nodes, whatever their geometry."""
    return b.groupBy("image").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("idx", "alias")))), 256).alias("signature"))


derived(
    "p11_exclusion", "documents labels",
    lambda d, lab: d.select("doc_id").join(lab.select("doc_id", F.struct(F.when(F.col("toxic") == 1, "problem").when(F.col("quality") == 0, "stage").alias("excluded")).alias("state")), "doc_id", "left").groupBy(F.coalesce("state.excluded", F.lit("none")).alias("excluded")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN toxic=1 THEN 'problem' WHEN quality=0 THEN 'stage' ELSE 'none' END AS excluded, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON l.doc_id=d.doc_id GROUP BY 1",
)
derived(
    "p13_currency", "part",
    lambda p: p.select("p_partkey", F.sha2("p_name", 256).alias("now")).join(p.select("p_partkey", F.sha2(F.when(F.col("p_size") % 4 == 0, F.reverse("p_name")).otherwise(F.col("p_name")), 256).alias("bound")), "p_partkey").where("now = bound").select("p_partkey"),
    "SELECT p_partkey FROM {part} WHERE p_size%4<>0 OR p_name=reverse(p_name)",
)
derived(
    "p20_text_channels", "events",
    lambda e: e.select("event_id", F.concat(F.lit('{"text":"t'), F.col("event_id").cast("string"), F.lit('","image_path":"p","sha256":"s","inner":{"note":"n","url":"u"}}')).alias("record")).select(
        "event_id", F.explode(F.from_json("record", "map<string,string>")).alias("k", "v")
    ).select("event_id", F.explode(F.when(F.startswith("v", F.lit("{")), F.map_entries(F.from_json("v", "map<string,string>"))).otherwise(F.array(F.struct(F.lit("").alias("key"), F.col("v").alias("value"))))).alias("x"), "k").select(
        "event_id", F.concat_ws(".", "k", F.nullif("x.key", F.lit(""))).alias("path"), F.col("x.value").alias("text")
    ).where("not path rlike '(path|sha256|url|hash)$'"),
    "SELECT event_id, 'text' AS path, 't'||event_id AS text FROM {events} UNION ALL SELECT event_id, 'inner.note', 'n' FROM {events}",
)
derived(
    "m08_answer_matching", "documents",
    lambda d: d.select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 256).alias("h")).join(d.groupBy(F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "h").select(
        "doc_id", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("first")).alias("matched")
    ),
    "WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k FROM {documents}) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY k)=1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN count(*) OVER (PARTITION BY k)=1 THEN doc_id END AS matched FROM k",
)

QUERIES, ORACLES = plan.queries, plan.oracles
