"""Registering queries: a Spark side and a DuckDB twin under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def frames(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    """Derived relations and tables by name, blank-separated."""
    return {n: getattr(tables, n)(spark, sf_dir) if n in tables.SQL else tables.load(spark, sf_dir, n) for n in names.split()}


class Plan:
    """The queries of one module. In SQL texts relations stand in braces, as ``{probes}``."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, relations: str = "", duck: str | None = None) -> None:
        """A query built with the DataFrame API and, if there is one, its DuckDB twin over the relations."""
        self.queries[name] = query
        if duck:
            self.oracles[name] = _plain(duck, relations)

    def sql(self, name: str, relations: str, text: str, duck: str | None = None) -> None:
        """A query in SQL; ``duck`` where DuckDB spells it another way."""
        self.add(name, lambda spark, sf_dir: spark.sql(text, **frames(spark, sf_dir, relations)), relations, duck or text)


def _plain(text: str, relations: str) -> str:
    for n in relations.split():
        text = text.replace("{" + n + "}", n)
    derived = " ".join(n for n in relations.split() if n in tables.SQL)
    if not derived:
        return text
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return tables.with_relations(derived, "").rstrip() + ",\n" + body[5:]
    return tables.with_relations(derived, body)
