"""Every registered query with SQL against DuckDB on the smallest tables; the others for rows and a stable schema."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from claimlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
