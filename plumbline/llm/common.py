"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: One or more of them, for Java, RE2 and Python alike.
BLANK_RUN = "[ \\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and (set_dir := spark.sparkContext.getCheckpointDir()) is not None:
        path = set_dir
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor; later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Removes all tables that this library wrote to the shared folder; call it when no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/plumbline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that no other column can clash; null texts stay null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not got."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The runs of non-blank characters in a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN, -1), lambda w: w != "")


def computed(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """``df`` with a column that later filters read but don't compute again.

    A filter on a plain projection moves below it with the expression written out, also inside
    lambdas, where it then runs for every element. Nothing moves below a generator whose output it reads.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))


def double_table(values) -> Column:
    """A foldable array<double> literal, for tables of constants inside expressions."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def one_thread() -> None:
    """Lets numpy's matrix library use one thread in this process: a task has one core, and waiting threads burn others.

    Where the library is another one than numpy's own, nothing happens.
    """
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


#: Sides of a join up to this many bytes are broadcast; larger ones are shuffled.
SMALL_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table marked for broadcast if its rows are few enough now, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df
