"""Streams over the journal: each is stopped, more arrives, and a new one goes on from the checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.components import shared_folder
from plumbline.sources import tables
from plumbline.streaming import journal

from .base import Plan

plan = Plan()


def _deliveries(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str, out: str, key: str) -> DataFrame:
    """What the sink holds after every part has been delivered; a stream of its own takes up each from the same checkpoint."""
    spark = parts[0].sparkSession
    root = f"{shared_folder(spark)}/plumbline/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = build(journal.events_stream(spark, f"{root}/in", parts[0].schema, files_per_trigger=1000))
        journal.run_to_end(stream, journal.numbered_sink(f"{root}/out"), mode, f"{root}/checkpoint")
    return journal.latest(spark, f"{root}/out", out, key)


def t01_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts arrive, then all others; the folded requests with their reasons."""
    a = tables.attempts(spark, sf_dir)
    return _deliveries([a.where("attempt = 0"), a.where("attempt > 0")], journal.fold, "update", journal.OUT, "request_id").where("attempt_count > 0")


plan.add(
    "t01_stream_fold", t01_stream_fold, "attempts",
    """WITH f AS (SELECT request_id, count(*) AS attempt_count, min(CASE WHEN kind='completed' THEN attempt END) AS done, min(CASE WHEN kind='nonretryable' THEN attempt END) AS dead, arg_max(kind, attempt) AS last_kind FROM {attempts} WHERE attempt<3 GROUP BY request_id)
SELECT request_id, attempt_count, CASE WHEN done IS NOT NULL AND (dead IS NULL OR done<dead) THEN 'completed' ELSE 'infrastructure_missing' END AS status,
  CASE WHEN done IS NOT NULL AND (dead IS NULL OR done<dead) THEN NULL WHEN dead IS NOT NULL THEN 'final_error' WHEN last_kind='started' THEN 'interrupted_request_unknown_response' ELSE 'retries_exhausted' END AS reason FROM f""",
)


def t02_first_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays of whole runs: later attempts come first, then everything again; the first delivery's earliest response stays."""
    a = tables.attempts(spark, sf_dir).where("kind = 'completed'").select("request_id", "attempt", "user_id")
    parts = [a.where("attempt >= 2"), a, a]
    return _deliveries(parts, lambda s: journal.first_in_order(s, "request_id", "attempt"), "append", "request_id long, attempt int, user_id long", "request_id")


plan.add(
    "t02_first_response", t02_first_response, "attempts",
    "SELECT request_id, coalesce(min(CASE WHEN attempt>=2 THEN attempt END), min(attempt)) AS attempt, coalesce(arg_min(user_id, attempt) FILTER (attempt>=2), arg_min(user_id, attempt)) AS user_id FROM {attempts} WHERE kind='completed' GROUP BY request_id",
)


def t04_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human answers to tasks: only confirmed ones with a text count, of tasks that were assigned; one immutable answer per task."""
    events = tables.load(spark, sf_dir, "events")
    assigned = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"))
    rows = events.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("props")).alias("text"), (F.col("value") > 5).alias("confirmed"))
    parts = [rows.where("seq % 5 = 0"), rows.where("seq % 5 = 1"), rows]

    def build(stream: DataFrame) -> DataFrame:
        valid = stream.where("confirmed AND text IS NOT NULL").join(assigned, "task", "left_semi")
        return journal.first_in_order(valid.select("task", "seq", "text"), "task", "seq")

    return _deliveries(parts, build, "append", "task long, seq long, text string", "task")


plan.add(
    "t04_submissions", t04_submissions, "events customer",
    """WITH v AS (SELECT user_id AS task, event_id AS seq, props AS text, CASE event_id%5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS delivery FROM events WHERE event_type<>'error' AND value>5 AND user_id IN (SELECT c_custkey FROM customer)),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY delivery, seq) AS rn FROM v) SELECT task, seq, text FROM r WHERE rn=1""",
)

QUERIES, ORACLES = plan.queries, plan.oracles
