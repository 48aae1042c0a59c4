"""Every library query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lexmill import oracle, queries


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in oracle.ORACLE_SQL:
        assert len(got.columns)
        return
    want = db.sql(oracle.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(map(repr, x[columns].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]
