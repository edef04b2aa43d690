"""Every panel query that SQL can express gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from saltern.plans import catalogue

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted((c, TYPES[t]) for c, t in got.dtypes) == sorted(zip(want.columns, map(str, want.types)))
    cols = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).columns
