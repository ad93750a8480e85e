"""Every registered query against its SQL on the smallest tables; those without SQL must run and keep their rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical
from palimpsest.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    got, want = canonical(QUERIES[name](spark, SF).toPandas()), canonical(db.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
