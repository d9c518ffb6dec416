"""Every grid query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillgrid.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(str(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    got, want = rows(catalog.queries()[name](spark, sf).toPandas()), rows(con.sql(catalog.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    clean = lambda r: tuple(v.removesuffix(" 00:00:00").removesuffix(".0") for v in r)
    assert list(map(clean, got[1])) == list(map(clean, want[1]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
