"""The DuckDB twins against the queries."""

import glob

import duckdb
import pytest

from plumbline.llm import queries

from .util import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df, twin = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(twin.columns) == columns
    same_rows([tuple(r[c] for c in columns) for r in df.collect()], [tuple(r[twin.columns.index(c)] for c in columns) for r in twin.fetchall()])
