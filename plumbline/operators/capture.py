"""Work on units that may fail: failures become rows beside the good ones, in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .components import written

#: Characters of an error's message that are kept.
MESSAGE = 300


class UnitError(Exception):
    """A failure with a code of its own; other exceptions have their class's name for a code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def captured(units: DataFrame, unit: str, work: Callable[[dict], dict], schema: str) -> DataFrame:
    """unit, result (a struct of ``schema``; null if it failed), code and message (null if it didn't) for every row.

    ``work`` takes a row as a dict and gives one with the fields of ``schema``; a field that lacks is null. Whatever it
    raises ends that unit alone. Also a result that doesn't fit its schema is a failure of its unit (code ``bad_result``), not of the task.
    Rows come back in the order they were read; nothing is shuffled.
    """
    fields = T._parse_datatype_string(schema).fields
    kinds = {f.name: f.dataType for f in fields}
    out = T.StructType([units.schema[unit], *fields, T.StructField("_code", T.StringType()), T.StructField("_message", T.StringType())])
    checks = {T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.StringType: str, T.BooleanType: bool}

    def one(row: dict) -> dict:
        try:
            result = work(row)
            for name, value in result.items():
                want = checks.get(type(kinds[name])) if name in kinds else None
                if value is not None and (want is None or not isinstance(value, want) or (isinstance(value, bool) and want is not bool)):
                    raise UnitError("bad_result", f"{name} is {type(value).__name__}")  # noqa: TRY301
        except Exception as e:  # noqa: BLE001
            return {"_code": getattr(e, "code", None) or type(e).__name__, "_message": str(e)[:MESSAGE]}
        return {name: result.get(name) for name in kinds}

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([one(row) | {unit: row[unit]} for row in rows], schema=arrow)

    rows = units.mapInArrow(run, out)
    ok = F.col("_code").isNull()
    return rows.select(unit, F.when(ok, F.struct(*(F.col(f"`{f.name}`") for f in fields))).alias("result"), F.col("_code").alias("code"), F.col("_message").alias("message"))


def two_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good results (unit and the result's fields) and failures (unit, code, message), written in one pass and read apart."""
    rows = written(rows, "captured")
    unit = rows.columns[0]
    return rows.where("code IS NULL").select(unit, "result.*"), rows.where("code IS NOT NULL").select(unit, "code", "message")
