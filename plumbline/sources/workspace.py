"""Workspaces of problems and stages: batch outputs split into them, folders scanned, every stage validated.

A workspace is partitioned by stage (``stage=pass1/...``), one record a line; folders with one file per problem and
stage are read too. Places are told from file paths, so a record that lies in the wrong one is found.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.variants import members, text
from plumbline.operators.components import written
from plumbline.operators.json_schema import schema_issues

#: The stages of a problem, in order (fixed values).
STAGES = ("pass1", "pass2", "pass3", "pass4")


def split_stages(batches: DataFrame, stages: tuple[str, ...] = STAGES, id_col: str = "id", record_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """Rows (problem, stage, record) of the batches that are whole, and issues (id, code) of the others.

    A batch is one JSON object with exactly the stages as keys, all with one and the same ``problem_id``, a text that isn't
    empty. Codes: ``unreadable``, ``missing:`` or ``unknown:`` and the stage, ``no_problem_id``, ``problem_ids_differ``. A batch with
    an issue is left out whole. Of a problem that two batches bring, neither is kept: ``problem_twice``.
    """
    want = F.array(*map(F.lit, stages))
    rows = batches.select(F.col(id_col).alias("id"), members(F.try_parse_json(record_col)).alias("m"))
    have = F.map_keys("m")
    ids = F.transform(F.filter(have, lambda k: k.isin(*stages)), lambda k: text(members(F.col("m")[k])["problem_id"]))
    named = F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False)))
    codes = F.when(F.col("m").isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.concat(
        F.transform(F.array_except(want, have), lambda s: F.concat(F.lit("missing:"), s)), F.transform(F.array_except(have, want), lambda s: F.concat(F.lit("unknown:"), s)),
        F.array(F.when(F.size(named) < F.size(ids), "no_problem_id"), F.when(F.size(F.array_distinct(named)) > 1, "problem_ids_differ")),
    )))
    told = written(rows.select("id", codes.alias("codes"), F.get(named, F.lit(0)).alias("problem"), F.transform_values("m", lambda _, v: F.to_json(v)).alias("records")), "stages")
    whole = told.where(F.size("codes") == 0)
    twice = whole.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("problem")
    good = whole.join(twice, "problem", "left_anti").select("problem", F.explode("records").alias("stage", "record"))
    bad = told.select("id", F.explode("codes").alias("code")).unionByName(whole.join(twice, "problem", "left_semi").select("id", F.lit("problem_twice").alias("code")))
    return good, bad


def write_workspace(rows: DataFrame, root: str) -> None:
    """Creates ``root``, a folder for each stage; refuses one that exists."""
    rows.select("stage", "record").write.mode("errorifexists").partitionBy("stage").text(root)


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """problem, stage, record, file and code of every record of a workspace.

    ``problem`` is what the record says; for one file per problem (``<stage>/<problem>.json``, whole files) it is what the path
    says. Codes: ``unreadable``, ``no_problem_id``, ``id_conflict`` (path and record differ), else null.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(root)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.regexp_extract("_metadata.file_path", "/stage=([^/]+)/[^/]+$", 1).alias("stage"), F.lit(None).cast("string").alias("place"))
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
    at = lambda k: F.regexp_extract("_metadata.file_path", r"/([^/]+)/([^/]+)\.json$", k)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), at(1).alias("stage"), at(2).alias("place"))
    rows = lines.unionByName(files).where("stage <> ''").withColumn("v", F.try_parse_json("value"))
    said = text(members(F.col("v"))["problem_id"])
    code = F.when(members(F.col("v")).isNull(), "unreadable").when(F.coalesce(said, F.lit("")) == "", "no_problem_id").when(F.col("place") != said, "id_conflict")
    return rows.select(F.coalesce("place", said).alias("problem"), "stage", F.col("value").alias("record"), "file", code.alias("code"))


def workspace_issues(scan: DataFrame, schemas: Mapping[str, dict], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """problem, stage, path and code over a whole workspace: what the scan found, stages that lack or come twice, and what breaks a stage's schema."""
    found = scan.where("code IS NOT NULL").select("problem", "stage", F.lit("").alias("path"), "code")
    there = scan.where("problem IS NOT NULL").groupBy("problem", "stage").agg(F.count(F.lit(1)).alias("n"))
    twice = there.where("n > 1").select("problem", "stage", F.lit("").alias("path"), F.lit("stage_twice").alias("code"))
    lacking = there.groupBy("problem").agg(F.array_except(F.array(*map(F.lit, stages)), F.collect_set("stage")).alias("lacks"))  # no more entries than stages
    missing = lacking.select("problem", F.explode("lacks").alias("stage"), F.lit("").alias("path"), F.lit("stage_missing").alias("code"))
    out = found.unionByName(twice).unionByName(missing)
    for stage, schema in schemas.items():
        records = scan.where((F.col("stage") == stage) & F.col("code").isNull())
        out = out.unionByName(schema_issues(records, schema, id_col="problem").select(F.col("id").alias("problem"), F.lit(stage).alias("stage"), "path", F.concat(F.lit("schema:"), "keyword").alias("code")))
    return out


def summary(scan: DataFrame, issues: DataFrame) -> DataFrame:
    """stage, code and numbers of issues and of problems with any, rolled up: a null code stands for all of a stage, a null stage for the workspace; code ``records`` counts all records."""
    rolled = issues.rollup("stage", "code").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("problem").alias("problems"))
    records = scan.groupBy("stage").agg(F.lit("records").alias("code"), F.count(F.lit(1)).alias("issues"), F.countDistinct("problem").alias("problems"))
    return rolled.unionByName(records)
