"""Walks over the keys of JSON records, to any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import variants

from .components import written

#: Keys under which credentials are kept (fixed values).
CREDENTIALS = ("api_key", "access_token", "auth_token", "authorization", "password", "secret")


def key_walk(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """id, path (JSON Pointer), key, kind and depth of every key of every record.

    ``record_col`` holds JSON texts; one that cannot be read, or repeats a key, gives one row whose key is null and whose
    kind is ``unreadable``. A null record gives none. Each level of nesting is one narrow pass over the containers of
    the one above, so it ends with the deepest record and shuffles nothing.
    """
    given = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("text")).where("text IS NOT NULL")
    given = given.select("id", F.lit("").alias("path"), F.try_parse_json("text").alias("value"))
    bad = given.where("value IS NULL").select("id", "path", F.lit(None).cast("string").alias("key"), F.lit("unreadable").alias("kind"), F.lit(0).alias("depth"))
    level, found, depth = given.where("value IS NOT NULL"), [bad], 0
    while depth == 0 or level.limit(1).count():
        depth += 1
        below = level.select("id", F.inline(variants.children(F.col("value"), F.col("path"))))
        below = written(below.select("id", "path", "key", "value", variants.kind(F.col("value")).alias("kind")), "keys")
        found.append(below.where("key IS NOT NULL").select("id", "path", "key", "kind", F.lit(depth).alias("depth")))
        level = below.where("kind IN ('object', 'array')").select("id", "path", "value")
    return reduce(DataFrame.unionByName, found)


def prohibited_keys(records: DataFrame, names: tuple[str, ...] = CREDENTIALS, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """id, path and key wherever a record has one of these keys, at any depth and in any case of letters; values don't matter.

    Unreadable records come too, with a null key: nobody can tell what they hold.
    """
    wanted: Column = F.lower("key").isin([n.lower() for n in names])
    return key_walk(records, id_col, record_col).where(F.col("key").isNull() | wanted).select("id", "path", "key")
