"""Every registered query against its SQL twin in DuckDB on the smallest data set."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    """A value as both engines give it: every null, NaN, NaT and NA is None."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
