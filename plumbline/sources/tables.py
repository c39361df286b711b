"""Tables of a scale-factor folder and the relations that the evaluation operators derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Rows of a task: of line items, and of narrow tables from which wide records are made.
ITEM_ROWS, WIDE_ROWS = 200_000, 10_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in NAMES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks of ``rows`` rows each ``df`` makes."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a narrow table dealt over tasks by their number; its file is one task's input, though what is made of it may be large."""
    return df.repartition(tasks_for(df, WIDE_ROWS))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``rn``, their number within the order (line numbers repeat in this table).

    They are dealt by order into tasks by their number, which joins and groups by order keep; so a task's memory doesn't grow.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    return lines.repartition(tasks_for(lines, ITEM_ROWS), "l_orderkey").withColumn("rn", F.row_number().over(order))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per test item: keys, type, pools and three-valued scores (null: the service gave no answer)."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    served, joint, paired = F.col("l_suppkey") % 17 != 0, F.col("l_returnflag") != "N", F.col("l_partkey") % 5 != 0
    return (
        items(spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("probe_id"),
            F.col("l_orderkey").alias("problem_id"),
            F.col("o_custkey").alias("cluster_id"),
            F.col("l_returnflag").alias("probe_type"),
            F.col("l_linestatus").alias("interface"),
            joint.alias("joint_eligible"),
            (F.col("l_linenumber") <= 2).alias("packet_nonempty"),
            paired.alias("paired"),
            F.when(served, (F.col("l_quantity") > 25).cast("int")).alias("b_raw"),
            F.when(served & joint, (F.col("l_partkey") % 3 != 0).cast("int")).alias("c_raw"),
            F.when(paired, (F.col("l_quantity") > 20).cast("int")).alias("b_gold"),
            (F.lit(2) + F.col("l_linenumber")).alias("k_candidates"),
            F.col("l_partkey").alias("l_partkey"),
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe under four models: a generator, not a join."""
    models = F.explode(F.array(*(F.lit(k) for k in range(4))))
    return probes(spark, sf_dir).select("probe_id", "problem_id", "cluster_id", "probe_type", "l_partkey", models.alias("m")).select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"),
        "probe_id",
        "problem_id",
        "cluster_id",
        "probe_type",
        ((F.col("l_partkey") + F.col("m") * 7) % 10 < F.col("m") + 5).cast("int").alias("b"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("problem_id"),
        F.col("o_orderstatus").alias("source"),
        F.when(F.col("o_custkey") % 7 != 0, (F.col("o_orderpriority") < "3").cast("int")).alias("answer"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request journal: started, completed, retryable and final errors."""
    kind = (
        F.when(F.col("event_type").isin("purchase", "signup"), "completed")
        .when(F.col("event_type") == "error", "retryable")
        .when(F.col("event_type") == "view", "nonretryable")
        .otherwise("started")
    )
    return load(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).cast("long").alias("request_id"), (F.col("event_id") % 4).cast("int").alias("attempt"), kind.alias("kind"), "ts", "user_id"
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers in eight shapes, five of them faulty."""
    owner, read, v = (1 + F.col("l_suppkey") % 3).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey") % 8
    text = (
        F.when(v == 0, F.concat(F.lit('```json\n{"owner":"E'), owner, F.lit('","read":"'), read, F.lit(' kg"}\n```')))
        .when(v == 1, F.concat(F.lit('{"owner":"E'), owner, F.lit('"} trailing')))
        .when(v == 2, F.concat(F.lit('{"owner":"E1","owner":"E'), owner, F.lit('"}')))
        .when(v == 3, F.lit('["E1"]'))
        .when(v == 4, F.lit(""))
        .when(v == 5, F.concat(F.lit('{"read":"'), read, F.lit(' kg"}')))
        .otherwise(F.concat(F.lit('{"owner":" E'), owner, F.lit(' ","read":"'), read, F.lit('kg"}')))
    )
    return items(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("rn")).alias("probe_id"), text.alias("response"), v.cast("int").alias("variant"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text twins, each linked with the first of its copies, and a chain graph on nodes under 200 (shifted to negative ids)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    twins = docs.join(first, "h").where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    n = spark.range(200).select((-1 - F.col("id")).alias("a"), (-8 - F.col("id")).alias("b"), "id").where("id % 3 = 0 and id + 7 < 200")
    return twins.unionByName(n.select("a", "b"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("image"), F.concat(F.lit("E"), p.cast("string")).alias("alias"), p.alias("idx"),
        (p * 37 % 900).alias("x0"), (p * 53 % 900).alias("y0"), (p * 37 % 900 + F.col("p_size")).alias("x1"), (p * 53 % 900 + p % 50).alias("y1"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return load(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("source").alias("mother"), F.col("doc_id").alias("probe"),
        F.when(F.col("quality") == 0, "rejected").otherwise("approved").alias("status"),
        F.when(F.col("toxic") == 1, "serious").when(F.col("quality") == 0, "minor").otherwise("none").alias("severity"),
    )


_ITEMS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"
#: The same relations for DuckDB, as common table expressions.
SQL = {
    "probes": f"""probes AS (SELECT l_orderkey*100+rn AS probe_id, l_orderkey AS problem_id, o_custkey AS cluster_id, l_returnflag AS probe_type, l_linestatus AS interface,
  l_returnflag<>'N' AS joint_eligible, l_linenumber<=2 AS packet_nonempty, l_partkey%5<>0 AS paired, CASE WHEN l_suppkey%17<>0 THEN CAST(l_quantity>25 AS INT) END AS b_raw,
  CASE WHEN l_suppkey%17<>0 AND l_returnflag<>'N' THEN CAST(l_partkey%3<>0 AS INT) END AS c_raw, CASE WHEN l_partkey%5<>0 THEN CAST(l_quantity>20 AS INT) END AS b_gold,
  2+l_linenumber AS k_candidates, l_partkey FROM {_ITEMS} x JOIN orders ON l_orderkey=o_orderkey)""",
    "runs": "runs AS (SELECT 'm'||m AS model, probe_id, problem_id, cluster_id, probe_type, CAST((l_partkey+m*7)%10 < m+5 AS INT) AS b FROM probes CROSS JOIN (SELECT unnest([0,1,2,3]) AS m))",
    "answers": "answers AS (SELECT o_orderkey AS problem_id, o_orderstatus AS source, CASE WHEN o_custkey%7<>0 THEN CAST(o_orderpriority<'3' AS INT) END AS answer FROM orders)",
    "attempts": """attempts AS (SELECT event_id//4 AS request_id, CAST(event_id%4 AS INT) AS attempt, CASE WHEN event_type IN ('purchase','signup') THEN 'completed' WHEN event_type='error' THEN 'retryable'
  WHEN event_type='view' THEN 'nonretryable' ELSE 'started' END AS kind, ts, user_id FROM events)""",
    "responses": f"""responses AS (SELECT l_orderkey*100+rn AS probe_id, CAST(l_partkey%8 AS INT) AS variant, CASE l_partkey%8
  WHEN 0 THEN concat('```json',chr(10),'{{"owner":"E',1+l_suppkey%3,'","read":"',l_linenumber,' kg"}}',chr(10),'```') WHEN 1 THEN concat('{{"owner":"E',1+l_suppkey%3,'"}} trailing')
  WHEN 2 THEN concat('{{"owner":"E1","owner":"E',1+l_suppkey%3,'"}}') WHEN 3 THEN '["E1"]' WHEN 4 THEN '' WHEN 5 THEN concat('{{"read":"',l_linenumber,' kg"}}')
  ELSE concat('{{"owner":" E',1+l_suppkey%3,' ","read":"',l_linenumber,'kg"}}') END AS response FROM {_ITEMS} x)""",
    "edges": """edges AS (SELECT m.a, d.doc_id AS b FROM documents d JOIN (SELECT text, min(doc_id) AS a FROM documents GROUP BY text) m ON d.text=m.text WHERE m.a<d.doc_id
  UNION ALL SELECT -1-id, -8-id FROM range(200) t(id) WHERE id%3=0 AND id+7<200)""",
    "boxes": "boxes AS (SELECT p_brand AS image, 'E'||p_partkey AS alias, p_partkey AS idx, p_partkey*37%900 AS x0, p_partkey*53%900 AS y0, p_partkey*37%900+p_size AS x1, p_partkey*53%900+p_partkey%50 AS y1 FROM part)",
    "reviews": """reviews AS (SELECT source AS mother, doc_id AS probe, CASE WHEN quality=0 THEN 'rejected' ELSE 'approved' END AS status, CASE WHEN toxic=1 THEN 'serious' WHEN quality=0 THEN 'minor' ELSE 'none' END AS severity
  FROM labels JOIN documents USING (doc_id))""",
}


def with_relations(names: str, body: str) -> str:
    """``body`` as SQL after the named relations (blank-separated); runs needs probes."""
    wanted = names.split()
    if "runs" in wanted and "probes" not in wanted:
        wanted.insert(0, "probes")
    return "WITH " + ",\n".join(SQL[n] for n in sorted(wanted, key=list(SQL).index)) + "\n" + body
