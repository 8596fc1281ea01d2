"""The driver contract: entry() runs, every query has an oracle text, and the
registered queries match their oracle on the driver's data (sf0.001 here;
tools/compare.py runs any scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from funnelwise.plans.queries import FURTHER
from tests.shopgen import multiset

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["yr", "qtr", "sessions", "orders"]
    assert df.count() > 0


def test_every_query_has_oracle():
    shop = set(E.spark_queries())
    assert len(shop) == 65 + len(FURTHER)
    assert shop == set(E.ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert multiset(df.columns, rows) == multiset(d_cols, cur.fetchall())
