"""Columns of type VARIANT: members, elements and kinds of JSON values, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def members(v: Column) -> Column:
    """The members of an object as map<string, variant>; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """The elements of an array as array<variant>; null for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def number(v: Column) -> Column:
    """The value as a double; null if it is no number (a text of digits is none)."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    """The value as a string; null if it is no string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null; a whole number is an integer however it is written."""
    scalar = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(F.is_variant_null(v), "null")
        .when(members(v).isNotNull(), "object")
        .when(elements(v).isNotNull(), "array")
        .when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean")
        .when((scalar == "BIGINT") | (whole == F.floor(whole)), "integer")
        .otherwise("number")
    )


def escaped(key: Column) -> Column:
    """A key as a token of a JSON Pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def children(v: Column, path: Column) -> Column:
    """array<struct<path, key, value>> of what an object or array holds; key is null for elements. Empty for scalars."""
    none = F.expr("cast(array() AS array<struct<path:string,key:string,value:variant>>)")
    own = F.transform(F.map_entries(members(v)), lambda e: F.struct(F.concat(path, F.lit("/"), escaped(e["key"])).alias("path"), e["key"].alias("key"), e["value"].alias("value")))
    at = F.transform(elements(v), lambda e, i: F.struct(F.concat(path, F.lit("/"), i.cast("string")).alias("path"), F.lit(None).cast("string").alias("key"), e.alias("value")))
    return F.concat(F.coalesce(own, none), F.coalesce(at, none))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas, where Catalyst shares nothing."""
    return F.transform(F.array(value), body)[0]
