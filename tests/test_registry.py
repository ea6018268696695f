"""Every query with SQL is compared with DuckDB on the same tables."""

import os

import duckdb
import pytest

from wavelens.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(object).values.tolist()), key=str) == sorted(map(tuple, want[cols].astype(object).values.tolist()), key=str)
