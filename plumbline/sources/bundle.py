"""Readers and writers of JSON bundles: strict records, inventories by hash, staged publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import strict_json

#: Records of a published file at most.
FILE_ROWS = 20_000


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """path, line and record (canonical text; null where a line is no strict object); blank lines are skipped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return rows.where(F.trim("line") != "").withColumn("record", strict_json.strict_json("line"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path and record of whole files, strictly; a byte-order mark is dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return rows.select("path", strict_json.strict_json("value").alias("record"))


def read_records(spark: SparkSession, path: str, kind: str = "auto", pointer: str = "") -> DataFrame:
    """Records of a JSON or JSONL source, the kind told by the suffix unless given.

    ``pointer`` leads to the array of records inside a JSON document; records come back as text.
    """
    if kind == "auto":
        kind = "jsonl" if path.endswith((".jsonl", ".ndjson")) else "json"
    if kind == "jsonl":
        return read_jsonl(spark, path)
    array = F.from_json(F.get_json_object("record", json_path(pointer)), "array<string>")
    return read_json(spark, path).select("path", F.explode(array).alias("record"))


def json_path(pointer: str) -> str:
    """A JSON Pointer as the path that ``get_json_object`` takes."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer is empty or starts with a slash")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if any("'" in p for p in parts):
        raise ValueError("a key with a quote")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), sha256 and size of every file; contents never come to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = root.rstrip("/").rpartition("/")[2]
    return files.select(F.substring_index(F.col("path"), f"/{name}/", -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def integrity_issues(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """path and code (missing, unexpected, changed) where two inventories differ."""
    a, e = actual.select("path", F.col("sha256").alias("a")), expected.select("path", F.col("sha256").alias("e"))
    code = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("changed")
    return a.join(e, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("e"))).select("path", code.alias("code"))


def closed_schema_issues(records: DataFrame, allowed: list[str], id_col: str, record_col: str = "record") -> DataFrame:
    """id and code for records that are no object, lack a field or have another one."""
    keys = F.json_object_keys(record_col)
    want = F.array(*map(F.lit, allowed))
    codes = F.when(F.col(record_col).isNull(), F.array(F.lit("not_an_object"))).otherwise(
        F.concat(F.transform(F.array_except(want, keys), lambda k: F.concat(F.lit("missing:"), k)), F.transform(F.array_except(keys, want), lambda k: F.concat(F.lit("unexpected:"), k)))
    )
    return records.select(F.col(id_col).alias("id"), F.explode(codes).alias("code"))


def publish(df: DataFrame, path: str) -> None:
    """Creates a JSONL folder; refuses one that exists. No file grows with the input, as a file's hash is one task's work."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS).json(path)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
