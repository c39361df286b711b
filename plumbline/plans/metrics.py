"""Headline metrics, bounds, comparisons, bootstrap and leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import pools
from plumbline.functions.strict_json import strict_json
from plumbline.operators.bootstrap import cluster_bootstrap
from plumbline.sources import tables

from .base import Plan

plan = Plan()
EQUAL = {"A": 1 / 3, "N": 1 / 3, "R": 1 / 3}
CUSTOM = {"A": 0.5, "N": 0.2, "R": 0.3}


def _mt(score: str, source: str = "{probes}", name: str = "") -> str:
    """SQL: problem and type means of one score."""
    return f"""mt{name} AS (SELECT probe_type, problem_id, count(*) AS m, sum(coalesce({score},0)) AS s0, sum(coalesce({score},1)) AS s1, count({score}) AS k FROM {source} GROUP BY 1,2),
ty{name} AS (SELECT probe_type, count(*) AS n_problems, CAST(sum(m) AS BIGINT) AS n_probes, CAST(sum(m-k) AS BIGINT) AS n_missing, sum(CAST(s0 AS DOUBLE)/m)/count(*) AS lower_v,
  sum(CAST(s1 AS DOUBLE)/m)/count(*) AS upper_v, sum(CAST(k AS DOUBLE)/m)/count(*) AS coverage FROM mt{name} GROUP BY 1)"""


def a01_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.rounded(pools.type_means(tables.probes(spark, sf_dir), "b_raw"))


plan.add(
    "a01_hier_mean_by_type", a01_by_type, "probes",
    f"WITH {_mt('b_raw')} SELECT probe_type, n_problems, n_probes, n_missing, round(lower_v,9) AS lower_v, round(upper_v,9) AS upper_v, round(coverage,9) AS coverage, "
    "CASE WHEN n_missing=0 THEN round(lower_v,9) END AS value FROM ty",
)


def _overall(weights):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pools.rounded(pools.combine(pools.type_means(tables.probes(spark, sf_dir), "b_raw"), weights))

    values = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in weights.items())
    total = lambda c: f"CASE WHEN count(*)=count({c}) THEN round(sum(w*{c}),9) END AS {c}"
    duck = f"WITH {_mt('b_raw')}, tv AS (SELECT *, CASE WHEN n_missing=0 THEN lower_v END AS value FROM ty) SELECT {', '.join(map(total, ('value', 'lower_v', 'upper_v', 'coverage')))} FROM (VALUES {values}) t(probe_type, w) LEFT JOIN tv USING (probe_type)"
    return query, duck


for _name, _weights in (("a01_hier_mean_overall", EQUAL), ("a01_hier_mean_custom_weights", CUSTOM)):
    _query, _duck = _overall(_weights)
    plan.add(_name, _query, "probes", _duck)


def served(df: DataFrame) -> DataFrame:
    """Probes with every answer there: the complete case that headline values need."""
    return df.where(F.col("b_raw").isNotNull())


def a04_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C, B and J over the joint pool, B over all; ratios only after aggregation."""
    full = served(tables.probes(spark, sf_dir)).withColumn("j", F.col("c_raw") * F.col("b_raw"))
    joint = full.where("joint_eligible")
    one = lambda df, score, name, w: pools.combine(pools.type_means(df, score), w).select(F.col("value").alias(name))
    two = {"A": 0.5, "R": 0.5}
    row = one(full, "b_raw", "BAcc", EQUAL).crossJoin(one(joint, "c_raw", "CAcc", two)).crossJoin(one(joint, "b_raw", "BAcc_L", two)).crossJoin(one(joint, "j", "JAcc", two))
    c, b, j = F.col("CAcc"), F.col("BAcc_L"), F.col("JAcc")
    up = lambda x: F.greatest(F.lit(0.0), x)
    return pools.rounded(
        row.select(
            "CAcc", "BAcc", "JAcc", "BAcc_L", F.try_divide(j, c).alias("BAcc_given_C"), (1 - F.try_divide(j, c)).alias("BindErr_given_C"),
            up(j).alias("q11"), up(c - j).alias("q10"), up(b - j).alias("q01"), up(1 - c - b + j).alias("q00"),
        )
    )


_S = "s AS (SELECT *, c_raw*b_raw AS j FROM {probes} WHERE b_raw IS NOT NULL), l AS (SELECT * FROM s WHERE joint_eligible)"
plan.add(
    "a04_headline", a04_headline, "probes",
    f"WITH {_S}, {_mt('b_raw', 's', '1')}, {_mt('c_raw', 'l', '2')}, {_mt('b_raw', 'l', '3')}, {_mt('j', 'l', '4')}, "
    "v AS (SELECT (SELECT sum(lower_v)/3 FROM ty1) AS BAcc, (SELECT sum(lower_v)/2 FROM ty2) AS CAcc, (SELECT sum(lower_v)/2 FROM ty3) AS BAcc_L, (SELECT sum(lower_v)/2 FROM ty4) AS JAcc) "
    "SELECT round(CAcc,9) AS CAcc, round(BAcc,9) AS BAcc, round(JAcc,9) AS JAcc, round(BAcc_L,9) AS BAcc_L, round(JAcc/nullif(CAcc,0),9) AS BAcc_given_C, round(1-JAcc/nullif(CAcc,0),9) AS BindErr_given_C, "
    "round(greatest(0,JAcc),9) AS q11, round(greatest(0,CAcc-JAcc),9) AS q10, round(greatest(0,BAcc_L-JAcc),9) AS q01, round(greatest(0,1-CAcc-BAcc_L+JAcc),9) AS q00 FROM v",
)


def a04_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against gold on paired probes; the delta's bounds pair opposite ends."""
    paired = tables.probes(spark, sf_dir).where("paired")
    both = [pools.combine(pools.type_means(paired, s), EQUAL) for s in ("b_raw", "b_gold")]
    r, g = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("value", "lower_v", "upper_v"))) for df, p in zip(both, "rg", strict=True))
    return pools.rounded(
        r.crossJoin(g).select(
            F.col("r_value").alias("BAcc"), F.col("g_value").alias("BAcc_gold"), (F.col("g_value") - F.col("r_value")).alias("delta"),
            (F.col("g_lower_v") - F.col("r_upper_v")).alias("delta_lo"), (F.col("g_upper_v") - F.col("r_lower_v")).alias("delta_hi"),
        )
    )


plan.add(
    "a04_paired_delta", a04_paired_delta, "probes",
    f"WITH p AS (SELECT * FROM {{probes}} WHERE paired), {_mt('b_raw', 'p', '1')}, {_mt('b_gold', 'p', '2')}, "
    "r AS (SELECT CASE WHEN sum(n_missing)=0 THEN sum(lower_v)/3 END AS v, sum(lower_v)/3 AS lo, sum(upper_v)/3 AS hi FROM ty1), g AS (SELECT CASE WHEN sum(n_missing)=0 THEN sum(lower_v)/3 END AS v, sum(lower_v)/3 AS lo, sum(upper_v)/3 AS hi FROM ty2) "
    "SELECT round(r.v,9) AS BAcc, round(g.v,9) AS BAcc_gold, round(g.v-r.v,9) AS delta, round(g.lo-r.hi,9) AS delta_lo, round(g.hi-r.lo,9) AS delta_hi FROM r, g",
)

plan.sql(
    "a05_support", "probes",
    """SELECT scope, count(*) AS planned_probes, count(v) AS served_probes, count(*)-count(v) AS missing_probes, count(DISTINCT problem_id) AS planned_problems,
  count(DISTINCT CASE WHEN v IS NOT NULL THEN problem_id END) AS served_problems, count(DISTINCT CASE WHEN c=1 THEN problem_id END) AS correctly_read_problems, count(CASE WHEN c=1 THEN 1 END) AS correctly_read
FROM (SELECT 'B' AS scope, problem_id, b_raw AS v, c_raw AS c FROM {probes} UNION ALL SELECT 'L', problem_id, b_raw, c_raw FROM {probes} WHERE joint_eligible
  UNION ALL SELECT 'P', problem_id, b_raw, c_raw FROM {probes} WHERE packet_nonempty) x GROUP BY scope""",
)


def a06_invalidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of answers that are no strict object, and of objects whose fields are no text with anything in it; parsed from the texts served."""
    parsed = tables.responses(spark, sf_dir).select(F.explode(F.array(strict_json("response"))).alias("record"))
    said = lambda f: F.coalesce(F.trim(F.get_json_object("record", f"$.{f}")) != "", F.lit(False))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), ok.alias("ok")) for n, ok in (("object", F.col("record").isNotNull()), ("owner", said("owner")), ("read", said("read")))))
    bad = F.count(F.when(~F.col("ok"), 1))
    return parsed.select(F.inline(fields)).groupBy("field").agg(F.count(F.lit(1)).alias("required_served"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 9).alias("rate"))


plan.add(
    "a06_invalidity", a06_invalidity, "responses",
    """SELECT field, count(*) AS required_served, count(CASE WHEN NOT ok THEN 1 END) AS invalid, round(CAST(count(CASE WHEN NOT ok THEN 1 END) AS DOUBLE)/count(*),9) AS rate
FROM (SELECT 'object' AS field, variant NOT IN (1,2,3,4) AS ok FROM {responses} UNION ALL SELECT 'owner', variant IN (0,6,7) FROM {responses} UNION ALL SELECT 'read', variant IN (0,5,6,7) FROM {responses}) x GROUP BY field""",
)
plan.sql(
    "a09_chance", "probes",
    """SELECT probe_type, round(sum(v)/count(*),9) AS chance FROM (SELECT probe_type, problem_id, sum(CAST(1 AS DOUBLE)/k_candidates)/count(*) AS v FROM {probes} GROUP BY probe_type, problem_id) x GROUP BY probe_type""",
)
plan.sql(
    "a10_chance_exact", "probes",
    """SELECT problem_id, CAST(sum(27720 / k_candidates) AS BIGINT) AS numerator, CAST(27720*count(*) AS BIGINT) AS denominator FROM {probes} GROUP BY problem_id""",
    """SELECT problem_id, CAST(sum(27720 // k_candidates) AS BIGINT) AS numerator, CAST(27720*count(*) AS BIGINT) AS denominator FROM {probes} GROUP BY problem_id""",
)
plan.queries["a10_chance_exact"] = lambda spark, d: tables.probes(spark, d).groupBy("problem_id").agg(
    F.sum(F.expr("27720 div k_candidates")).cast("long").alias("numerator"), (F.count(F.lit(1)) * 27720).cast("long").alias("denominator")
)
plan.sql(
    "a11_association", "probes answers",
    """WITH pm AS (SELECT problem_id, avg(b_gold) AS b FROM {probes} WHERE paired GROUP BY problem_id), an AS (SELECT problem_id, answer FROM {answers} WHERE answer IS NOT NULL),
x AS (SELECT an.problem_id, answer, b FROM an JOIN pm ON an.problem_id=pm.problem_id)
SELECT round((SELECT avg(answer) FROM an),9) AS SolveAcc, count(*) AS n, round(avg(CASE WHEN answer=1 THEN b END),9) AS mean_correct, round(avg(CASE WHEN answer=0 THEN b END),9) AS mean_wrong,
  round(avg(CASE WHEN answer=1 THEN b END)-avg(CASE WHEN answer=0 THEN b END),9) AS delta FROM x""",
)


def a12_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: harmed, repaired, both, neither from raw to gold; then the hierarchical mean of each event."""
    df = tables.probes(spark, sf_dir).where("paired and b_raw is not null")
    a, b = F.col("b_raw"), F.col("b_gold")
    event = F.explode(F.array(*(F.struct(F.lit(n).alias("event"), v.alias("v")) for n, v in (("H", a * (1 - b)), ("R", (1 - a) * b), ("both_correct", a * b), ("both_wrong", (1 - a) * (1 - b)), ("net", b - a)))))
    long = df.select("problem_id", "probe_type", event.alias("e")).select("problem_id", "probe_type", "e.event", "e.v")
    return pools.rounded(pools.combine(pools.type_means(long, "v", ["event"]), EQUAL, ["event"]).select("event", "value"))


_ev = "SELECT problem_id, probe_type, b_raw*(1-b_gold) AS h, (1-b_raw)*b_gold AS r, b_raw*b_gold AS bc, (1-b_raw)*(1-b_gold) AS bw, b_gold-b_raw AS net FROM {probes} WHERE paired AND b_raw IS NOT NULL"
plan.add(
    "a12_transitions", a12_transitions, "probes",
    f"WITH e AS ({_ev}), m AS (SELECT probe_type, problem_id, avg(h) h, avg(r) r, avg(bc) bc, avg(bw) bw, avg(net) net FROM e GROUP BY 1,2), t AS (SELECT probe_type, avg(h) h, avg(r) r, avg(bc) bc, avg(bw) bw, avg(net) net FROM m GROUP BY 1), "
    "s AS (SELECT sum(h)/3 h, sum(r)/3 r, sum(bc)/3 bc, sum(bw)/3 bw, sum(net)/3 net FROM t) "
    "SELECT 'H' AS event, round(h,9) AS value FROM s UNION ALL SELECT 'R', round(r,9) FROM s UNION ALL SELECT 'both_correct', round(bc,9) FROM s UNION ALL SELECT 'both_wrong', round(bw,9) FROM s UNION ALL SELECT 'net', round(net,9) FROM s",
)
plan.sql(
    "a13_consistency", "runs",
    """WITH x AS (SELECT r.model AS variant, r.probe_type, r.problem_id, avg(CASE WHEN r.b=c.b THEN 1.0 ELSE 0.0 END) AS v FROM {runs} r JOIN {runs} c ON r.probe_id=c.probe_id AND c.model='m0' WHERE r.model<>'m0' GROUP BY 1,2,3)
SELECT variant, round(sum(v)/3,9) AS consistency FROM (SELECT variant, probe_type, avg(v) AS v FROM x GROUP BY 1,2) t GROUP BY variant""",
)
plan.queries["a13_consistency"] = lambda spark, d: _consistency(tables.runs(spark, d))


def _consistency(runs: DataFrame) -> DataFrame:
    """Agreement with the reference model m0: one shuffle by probe instead of a self-join."""
    wide = runs.groupBy("probe_id", "problem_id", "probe_type").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.first("b"))
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("variant"), (F.col(m) == F.col("m0")).cast("int").alias("v")) for m in ("m1", "m2", "m3"))))
    long = wide.select("problem_id", "probe_type", pair.alias("p")).select("problem_id", "probe_type", "p.*")
    return pools.rounded(pools.combine(pools.type_means(long, "v", ["variant"]), EQUAL, ["variant"]).select("variant", F.col("value").alias("consistency")))


plan.sql(
    "a15_solve_by_source", "answers",
    """SELECT source, count(*) AS mothers, count(answer) AS graded, count(*)-count(answer) AS ungraded, CAST(sum(coalesce(answer,0)) AS BIGINT) AS correct,
  CASE WHEN count(*)=count(answer) THEN round(avg(CAST(answer AS DOUBLE)),9) END AS SolveAcc, round(CAST(sum(coalesce(answer,0)) AS DOUBLE)/count(*),9) AS lower_v, round(CAST(sum(coalesce(answer,1)) AS DOUBLE)/count(*),9) AS upper_v FROM {answers} GROUP BY source""",
)


def _by(level: str):
    return lambda spark, d: pools.rounded(
        pools.type_means(served(tables.probes(spark, d)), "b_raw", [level]).groupBy(F.col(level).cast("string").alias("level")).agg(F.sum("n_probes").alias("n_probes"), F.sum("n_problems").alias("n_type_problems"), F.avg("value").alias("BAcc"))
    )


for _level in ("interface", "k_candidates"):
    plan.add(
        f"a16_by_{_level}", _by(_level), "probes",
        f"WITH m AS (SELECT {_level} AS lv, probe_type, problem_id, count(*) AS n, avg(b_raw) AS v FROM {{probes}} WHERE b_raw IS NOT NULL GROUP BY 1,2,3), t AS (SELECT lv, probe_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS p, avg(v) AS v FROM m GROUP BY 1,2) "
        "SELECT CAST(lv AS VARCHAR) AS level, CAST(sum(n) AS BIGINT) AS n_probes, CAST(sum(p) AS BIGINT) AS n_type_problems, round(avg(v),9) AS BAcc FROM t GROUP BY 1",
    )


def _model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.combine(pools.type_means(tables.runs(spark, sf_dir), "b", ["model"]), EQUAL, ["model"]).select("model", F.col("value").alias("score"))


def a18_model_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target minus reference for each unordered pair of models; pairs are formed after aggregation."""
    s = _model_scores(spark, sf_dir)
    a, b = s.select(F.col("model").alias("reference"), F.col("score").alias("x")), s.select(F.col("model").alias("target"), F.col("score").alias("y"))
    return pools.rounded(a.join(b, F.col("reference") < F.col("target")).select("target", "reference", F.lit("BAcc").alias("metric"), (F.col("y") - F.col("x")).alias("diff")))


_scores = "m AS (SELECT model, probe_type, problem_id, avg(b) AS v FROM {runs} GROUP BY 1,2,3), s AS (SELECT model, sum(v)/3 AS score FROM (SELECT model, probe_type, avg(v) AS v FROM m GROUP BY 1,2) t GROUP BY 1)"
plan.add("a18_model_contrasts", a18_model_contrasts, "runs", f"WITH {_scores} SELECT b.model AS target, a.model AS reference, 'BAcc' AS metric, round(b.score-a.score,9) AS diff FROM s a JOIN s b ON a.model<b.model")


def w01_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared ranks (1, 1, 3); the window runs over one row per model."""
    s = pools.rounded(_model_scores(spark, sf_dir))
    return s.select("model", "score", F.rank().over(Window.orderBy(F.desc("score"))).cast("long").alias("rank"))


plan.add("w01_leaderboard", w01_leaderboard, "runs", f"WITH {_scores} SELECT model, round(score,9) AS score, CAST(rank() OVER (ORDER BY round(score,9) DESC) AS BIGINT) AS rank FROM s")
plan.add(
    "w01_filtered", lambda s, d: w01_leaderboard(s, d).where("model <> 'm3'"), "runs",
    f"WITH {_scores}, r AS (SELECT model, round(score,9) AS score, CAST(rank() OVER (ORDER BY round(score,9) DESC) AS BIGINT) AS rank FROM s) SELECT * FROM r WHERE model <> 'm3'",
)

REPLICATES, SEED = 2000, 2027


def a19_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = tables.probes(spark, sf_dir).where("paired and b_raw is not null")
    return pools.rounded(cluster_bootstrap(paired, {"raw": "b_raw", "gold": "b_gold"}, EQUAL, replicates=REPLICATES, seed=SEED), 7)


plan.add(
    "a19_bootstrap_hash", a19_bootstrap, "probes",
    f"""WITH p AS (SELECT * FROM {{probes}} WHERE paired AND b_raw IS NOT NULL),
cl AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id)-1 AS ix FROM (SELECT DISTINCT cluster_id FROM p) q), n AS (SELECT count(*) AS n FROM cl),
dr AS (SELECT r, ('0x'||substr(sha256(concat('{SEED}',':',r,':',slot//8)),1+8*(slot%8),8))::BIGINT % n.n AS ix FROM n, range({REPLICATES}) a(r), LATERAL (SELECT unnest(range(n.n)) AS slot) s),
mu AS (SELECT r, cluster_id, count(*) AS c FROM dr JOIN cl USING (ix) GROUP BY 1,2),
pm AS (SELECT cluster_id, probe_type, problem_id, avg(b_raw) AS a, avg(b_gold) AS b FROM p GROUP BY 1,2,3), cm AS (SELECT cluster_id, probe_type, count(*) AS k, sum(a) AS a, sum(b) AS b FROM pm GROUP BY 1,2),
ty AS (SELECT r, probe_type, sum(c*a)/sum(c*k) AS a, sum(c*b)/sum(c*k) AS b FROM mu JOIN cm USING (cluster_id) GROUP BY 1,2),
st AS (SELECT r, CASE WHEN count(*)=3 THEN sum(a)/3 END AS a, CASE WHEN count(*)=3 THEN sum(b)/3 END AS b FROM ty GROUP BY 1),
es AS (SELECT sum(a)/3 AS a, sum(b)/3 AS b FROM (SELECT probe_type, sum(a)/sum(k) AS a, sum(b)/sum(k) AS b FROM cm GROUP BY 1) t),
lg AS (SELECT 'raw' AS statistic, a AS v FROM st UNION ALL SELECT 'gold', b FROM st UNION ALL SELECT 'gold_minus_raw', b-a FROM st),
el AS (SELECT 'raw' AS statistic, a AS estimate FROM es UNION ALL SELECT 'gold', b FROM es UNION ALL SELECT 'gold_minus_raw', b-a FROM es)
SELECT statistic, round(any_value(estimate),7) AS estimate, CASE WHEN count(*)=count(v) THEN round(quantile_cont(v,0.025),7) END AS lower_v, CASE WHEN count(*)=count(v) THEN round(quantile_cont(v,0.975),7) END AS upper_v,
  count(v) AS valid, count(*)-count(v) AS undefined, CASE WHEN count(*)=count(v) THEN 'ok' ELSE 'withheld' END AS status FROM lg JOIN el USING (statistic) GROUP BY statistic""",
)

plan.sql(
    "a21_agreement", "runs",
    """WITH g AS (SELECT probe_id, count(*) AS n, sum(b) AS k FROM {runs} GROUP BY probe_id)
SELECT CAST(sum(n*(n-1)/2) AS BIGINT) AS pairs, CAST(sum(k*(k-1)/2 + (n-k)*(n-k-1)/2) AS BIGINT) AS agreeing, round(sum(CAST(k*(k-1)/2 + (n-k)*(n-k-1)/2 AS DOUBLE))/sum(n*(n-1)/2),9) AS rate FROM g""",
)
plan.sql(
    "a22_decisions", "reviews",
    """SELECT mother AS task, CASE WHEN count(CASE WHEN severity='serious' AND status='rejected' THEN 1 END)>0 THEN 'unresolved' WHEN count(CASE WHEN status<>'approved' THEN 1 END)=0 THEN 'accept' ELSE 'missing' END AS decision, count(*) AS n FROM {reviews} GROUP BY mother""",
)
plan.sql(
    "a30_yield_report", "probes",
    """SELECT CASE WHEN probe_type IS NOT NULL THEN 'probe_type' WHEN interface IS NOT NULL THEN 'interface' WHEN j IS NOT NULL THEN 'joint_eligible' ELSE 'all' END AS stratum, coalesce(probe_type, interface, j, 'all') AS level, count(*) AS n
FROM (SELECT probe_type, interface, CASE WHEN joint_eligible THEN 'true' ELSE 'false' END AS j FROM {probes}) x GROUP BY GROUPING SETS ((probe_type),(interface),(j),())""",
)
plan.sql("a37_profile", "probes", """SELECT probe_type, count(*) AS probes_B, count(CASE WHEN joint_eligible THEN 1 END) AS probes_L, count(DISTINCT problem_id) AS mothers, count(CASE WHEN paired THEN 1 END) AS paired FROM {probes} GROUP BY probe_type""")
plan.sql(
    "a38_bins", "probes answers",
    """WITH pm AS (SELECT problem_id, avg(CAST(b_gold AS DOUBLE)) AS b FROM {probes} WHERE paired GROUP BY problem_id),
x AS (SELECT CASE WHEN b<0.2 THEN 0 WHEN b<0.4 THEN 1 WHEN b<0.6 THEN 2 WHEN b<0.8 THEN 3 ELSE 4 END AS bin, answer FROM pm JOIN {answers} a ON pm.problem_id=a.problem_id WHERE answer IS NOT NULL)
SELECT k.bin, count(x.bin) AS n, round(avg(answer),9) AS value FROM (VALUES (0),(1),(2),(3),(4)) AS k(bin) LEFT JOIN x ON k.bin=x.bin GROUP BY k.bin""",
)
plan.sql("a39_mother_records", "probes", """SELECT problem_id, count(*) AS probes, CASE WHEN count(*)=count(b_raw) THEN round(avg(b_raw),9) END AS b, CASE WHEN count(*)=count(c_raw) THEN round(avg(c_raw),9) END AS c FROM {probes} GROUP BY problem_id""")
plan.sql(
    "a43_quartiles", "documents",
    """SELECT lang, percentile(n_chars, 0.25) AS q1, percentile(n_chars, 0.5) AS median, percentile(n_chars, 0.75) AS q3 FROM {documents} GROUP BY lang""",
    """SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang""",
)
plan.sql("a45_best_flags", "runs", """WITH s AS (SELECT model, probe_type, round(avg(b),9) AS v FROM {runs} GROUP BY 1,2) SELECT model, probe_type, v, v = max(v) OVER (PARTITION BY probe_type) AS best FROM s""")

QUERIES, ORACLES = plan.queries, plan.oracles
