"""The request journal and submissions as streams that may be killed and started again at any time.

Folding is per key and monotone, so a stream's final state equals the batch fold over the same rows. Sinks write a
micro-batch to a folder of its number, so one that comes twice replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "request_id long, status string, reason string, attempt_count long"
MAX_ATTEMPTS = 3


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def status_counts(attempts: DataFrame) -> DataFrame:
    """Attempts per kind; for update or complete mode."""
    return attempts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_submissions(submissions: DataFrame, key: str) -> DataFrame:
    """One immutable row per key: the first to arrive, however late another comes; of those in one micro-batch any.

    Keys are never forgotten, so state grows with the tasks that have an answer; use the RocksDB state store for many.
    """
    return submissions.dropDuplicates([key])


#: Rows that a task holds before it keeps only the first of each key.
HELD = 1 << 18


def first_in_order(submissions: DataFrame, key: str, order: str) -> DataFrame:
    """One immutable row per key: of the first micro-batch that has any the one with the least ``order``; nothing changes it later.

    A key's rows of a micro-batch meet in one task, which passes on the first by ``order`` (null last), then by the other flat columns;
    of these Spark's own state keeps the keys that it has seen, no Python call per key. Keys are never forgotten.
    """

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, rows = None, [], 0

        def reduced() -> pa.Table:
            table = pa.Table.from_batches(held)
            return _firsts(table if kept is None else pa.concat_tables([kept, table]), key, order)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= max(HELD, 0 if kept is None else kept.num_rows):
                kept, held, rows = reduced(), [], 0
        if held:
            kept = reduced()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=10_000)

    return submissions.repartition(F.col(key)).mapInArrow(least, submissions.schema).dropDuplicates([key])


def _firsts(table: pa.Table, key: str, order: str) -> pa.Table:
    """The first row of each key by ``order``, then by the other flat columns."""
    rest = [f.name for f in table.schema if f.name not in (key, order) and not pa.types.is_nested(f.type)]
    places = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (order, *rest)])
    ranked = pa.table({"key": table.column(key).take(places), "place": np.arange(len(places))})
    return table.take(places.take(ranked.group_by("key", use_threads=False).aggregate([("place", "min")]).column("place_min")))


def windowed_counts(attempts: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts per event-time window, final once the watermark has passed."""
    return attempts.withWatermark(time, late).groupBy(F.window(time, width), "kind").agg(F.count(F.lit(1)).alias("n"))


def fold(attempts: DataFrame) -> DataFrame:
    """Latest status per request; every trigger gives the requests that changed. For update mode.

    Counts, least attempts and the last one are aggregates that Spark keeps as state; of equal attempts the greatest kind is the last.
    """
    counted = F.col("attempt") < MAX_ATTEMPTS
    first = lambda kind: F.min(F.when(counted & (F.col("kind") == kind), F.col("attempt")))
    x = attempts.groupBy("request_id").agg(
        F.count(F.when(counted, 1)).alias("attempt_count"), first("completed").alias("done"), first("nonretryable").alias("dead"), F.max(F.when(counted, F.struct("attempt", "kind"))).alias("last")
    )
    completed = F.col("done").isNotNull() & (F.col("dead").isNull() | (F.col("done") < F.col("dead")))
    reason = F.when(completed, None).when(F.col("dead").isNotNull(), "final_error").when(F.col("last.kind") == "started", "interrupted_request_unknown_response").otherwise("retries_exhausted")
    return x.select("request_id", F.when(completed, "completed").otherwise("infrastructure_missing").alias("status"), reason.alias("reason"), "attempt_count")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """All rows that are there now, in micro-batches; ``sink`` (batch, number) must bear repeats."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def numbered_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to the folder of its number; a batch that comes again after a crash replaces what it left."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def latest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """What a ``numbered_sink`` holds in the end: for each key the row of the last batch that had it."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("x")).select(key, "x.*")
