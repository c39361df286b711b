"""Every query with a DuckDB twin gives the twin's rows on the small tables."""

import glob
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plumbline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_twin(spark, duck, name):
    df, twin = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    columns, there = sorted(df.columns), twin.columns
    assert sorted(there) == columns
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    want = sorted(([plain(r[there.index(c)]) for c in columns] for r in twin.fetchall()), key=str)
    assert got and got == want


def test_the_rest_runs(spark):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, SF).count() > 0, name


def test_bootstrap_draws_as_often_as_the_reference(spark):
    rows = catalog.queries()["a19_bootstrap_hash"](spark, SF).collect()
    assert rows and all(r["valid"] + r["undefined"] == 2000 for r in rows)


def test_the_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
