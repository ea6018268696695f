"""Every text query with SQL is compared with DuckDB on the same tables."""

import os

import duckdb
import pytest

from wavelens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(object).values.tolist())) == sorted(map(tuple, want[cols].astype(object).values.tolist()))
