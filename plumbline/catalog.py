"""All queries of the evaluation operators and their DuckDB twins, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``plumbline.plans``; each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("metrics", "records", "curation", "bundles", "checks", "contracts", "streams")


def _plans():
    return [importlib.import_module(f"plumbline.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _plans() for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.ORACLES.items()}
