"""Image files as rows: kind and size read from the headers, broken files as codes, never as errors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: Bytes that are looked at first; only files whose header goes beyond are passed on whole.
PREFIX = 1 << 16

#: Fixed values of the formats: signatures, markers without a segment, markers that end the header, frame headers.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
_BARE, _END = {0x01, *range(0xD0, 0xD9)}, {0xD9, 0xDA}
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}

_MARKER = re.compile(rb"\xff+([^\xff])", re.S)
_MORE = (None, None, None, "more")


def header(data: bytes, size: int) -> tuple[str | None, int | None, int | None, str | None]:
    """mime, width, height and code (null if all is well) of a file of ``size`` bytes, of which ``data`` are the first.

    The code is ``more`` if these don't tell.
    """
    whole = len(data) >= size
    if data.startswith(PNG):
        if len(data) < min(size, 24):
            return _MORE
        if size < 33 or data[12:16] != b"IHDR":
            return None, None, None, "no_header_chunk"
        return "image/png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), None
    return _frame(data, size, whole) if data.startswith(JPEG) else (None, None, None, "unsupported")


def _frame(data: bytes, size: int, whole: bool) -> tuple:
    def bad(code: str, at_end: bool = True) -> tuple:
        return _MORE if at_end and not whole else (None, None, None, code)

    at = 2
    while found := _MARKER.match(data, at):
        marker, at = found[1][0], found.end()
        if marker in _END:
            return bad("no_frame", False)
        if marker in _BARE:
            continue
        segment = data[at : at + 7]
        if len(segment) < 2:
            return bad("truncated_segment")
        length = int.from_bytes(segment[:2], "big")
        if length < 2 or at + length > size:
            return bad("segment_length", False)
        if marker in _FRAMES:
            if length < 8:
                return bad("truncated_frame", False)
            return bad("truncated_frame") if len(segment) < 7 else ("image/jpeg", int.from_bytes(segment[5:7], "big"), int.from_bytes(segment[3:5], "big"), None)
        at += length
    if at >= len(data):
        return bad("no_frame")
    return bad("truncated_marker") if not data[at:].strip(b"\xff") else bad("marker", False)


@pandas_udf(T.StructType([T.StructField("mime", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("code", T.StringType())]))
def _headers(data: pd.Series, size: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None, None) if d is None else header(bytes(d), int(n)) for d, n in zip(data, size, strict=True)]
    out = pd.DataFrame(rows, columns=["mime", "width", "height", "code"])
    return out.astype({"width": "Int64", "height": "Int64"})


def with_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with mime, width, height and code instead of their content. A null content has the code ``missing``."""
    data, size = F.col(content), F.coalesce(F.length(content), F.lit(0)).cast("long")
    first = files.withColumn("_first", _headers(F.substring(data, 1, PREFIX), size)).withColumn("_again", F.col("_first.code") == "more")
    second = first.withColumn("_second", _headers(F.when(F.col("_again"), data), size))
    take: Column = F.when(F.col("_again"), F.col("_second")).otherwise(F.col("_first"))
    kept = [c for c in files.columns if c != content]
    found = second.select(*kept, data.isNull().alias("_none"), take.alias("_h"))
    return found.select(*kept, "_h.mime", "_h.width", "_h.height", F.when(F.col("_none"), "missing").otherwise(F.col("_h.code")).alias("code"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256 of the bytes and the header of every file below ``root``; Spark's source lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return with_headers(files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content"))


def dimension_issues(images: DataFrame, declared: DataFrame) -> DataFrame:
    """path and code where an attachment isn't the image that its record declares (path, mime, width, height).

    ``unreadable:`` and why, ``missing`` (no such file), ``mime`` or ``dimensions``; one row for each declaration that doesn't hold.
    """
    want = declared.select("path", *(F.col(c).alias(f"want_{c}") for c in ("mime", "width", "height")))
    got = images.select("path", "mime", "width", "height", F.coalesce("code", F.lit("")).alias("state"))
    same = F.col("width").eqNullSafe(F.col("want_width")) & F.col("height").eqNullSafe(F.col("want_height"))
    code = (
        F.when(F.col("state").isNull(), "missing").when(F.col("state") != "", F.concat(F.lit("unreadable:"), "state"))
        .when(~F.col("mime").eqNullSafe(F.col("want_mime")), "mime").when(~same, "dimensions")
    )
    return want.join(got, "path", "left").select("path", code.alias("code")).where("code IS NOT NULL")
