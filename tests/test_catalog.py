"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tracelake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert rows == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
