"""Every query with a SQL counterpart gives the same rows on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.parity import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    assert compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
