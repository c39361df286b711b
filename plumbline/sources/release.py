"""Publishing folders: staged beside their place, sealed with a manifest of hashes, moved there by one rename, verified on reading.

All file work goes through Hadoop's file systems, so paths may be those of any store that Spark reads. The rename
is atomic where the store's is (HDFS and local disks; object stores copy). What a failed writer leaves behind is a hidden
staging folder, kept for diagnosis, that nothing reads as a release.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundle

MANIFEST, POINTER = "_manifest", "_current"
_MANIFEST_SCHEMA = "path string, sha256 string, size long"


class PublishError(ValueError):
    """A release that is there already, isn't sealed, or isn't what its manifest says."""


class _Store:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def rename(self, old: str, new: str, overwrite: bool = False) -> None:
        """Fails if ``new`` is there, unless a file may replace a file."""
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getDeclaringClass(), 1)
        options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        new = self.fs.makeQualified(self.path(new))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf).rename(self.fs.makeQualified(self.path(old)), new, options)

    def write(self, path: str, text: str) -> None:
        """A new file, on the disks before this returns."""
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    return _Store(spark, path).exists(path)


def beside(path: str, what: str) -> str:
    """A hidden name of its own in the folder of ``path``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{what}-{uuid.uuid4().hex}"


def seal(spark: SparkSession, root: str) -> None:
    """Writes the manifest of a folder: path, hash and size of every file that readers see; empty files, which Spark's source doesn't list, aren't covered."""
    bundle.inventory(spark, root).write.mode("errorifexists").json(f"{root}/{MANIFEST}")


@contextmanager
def staged(spark: SparkSession, final: str) -> Iterator[str]:
    """The staging folder for ``final``; when the block ends well it is sealed and renamed, else ``final`` never comes to be.

    Refuses a ``final`` that exists, at the start and by the rename itself.
    """
    store, stage = _Store(spark, final), beside(final, "staging")
    if store.exists(final):
        raise PublishError(f"{final} exists; publish to a new folder")
    store.fs.mkdirs(store.path(stage))
    yield stage
    seal(spark, stage)
    if store.exists(final):
        raise PublishError(f"{final} came to be meanwhile")
    store.rename(stage, final)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256 and size as sealed."""
    if not _Store(spark, root).exists(f"{root}/{MANIFEST}/_SUCCESS"):
        raise PublishError(f"{root} isn't sealed")
    return spark.read.schema(_MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """path and code (missing, unexpected, changed) wherever a sealed folder isn't what its manifest says."""
    return bundle.integrity_issues(bundle.inventory(spark, root), manifest(spark, root))


def verified(spark: SparkSession, root: str) -> str:
    """``root``, if it is sealed and intact."""
    issues = verify(spark, root).orderBy("path").limit(3).collect()
    if issues:
        raise PublishError(f"{root}: " + ", ".join(f"{r.path} {r.code}" for r in issues))
    return root


def replace(df: DataFrame, root: str) -> str:
    """Makes ``df`` the current version of ``root``: a folder of its own, sealed, then one rename of a pointer file.

    Readers see the old version or the new one whole; versions stay where they are. Returns the version's folder.
    """
    spark = df.sparkSession
    store, version = _Store(spark, root), f"{root}/v-{uuid.uuid4().hex}"
    with staged(spark, version) as stage:
        df.write.parquet(f"{stage}/data")
    pointer = beside(f"{root}/{POINTER}", "new")
    store.write(pointer, version.rpartition("/")[2])
    store.rename(pointer, f"{root}/{POINTER}", overwrite=True)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the current version, verified."""
    store = _Store(spark, root)
    if not store.exists(f"{root}/{POINTER}"):
        raise PublishError(f"{root} has no version yet")
    return spark.read.parquet(verified(spark, f"{root}/{store.read(f'{root}/{POINTER}')}") + "/data")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """path of the sealed versions of ``root`` and the number of their files."""
    rows = spark.read.schema(_MANIFEST_SCHEMA).json(f"{root}/v-*/{MANIFEST}").select(F.col("_metadata.file_path").alias("file"))
    return rows.groupBy(F.substring_index("file", f"/{MANIFEST}/", 1).alias("path")).agg(F.count(F.lit(1)).alias("files"))
