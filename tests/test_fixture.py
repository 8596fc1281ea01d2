"""The Spark derivation of the shop tables equals the DuckDB prelude row by row,
also with tiny chunks (the skew-safe numbering path)."""

import duckdb
import pytest

from funnelwise.plans.prelude import with_prelude
from funnelwise.sources.events_fixture import derive_shop_tables
from funnelwise.sources.schema import check_keys
from tests.shopgen import multiset

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", [1 << 20, 5])
def test_derivation_equals_duckdb_prelude(spark, chunk):
    events = spark.read.parquet(f"{SF}/events.parquet")
    tables = derive_shop_tables(events, chunk=chunk)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    for name, df in tables.as_dict().items():
        s_rows = [tuple(r) for r in df.collect()]
        cur = con.execute(with_prelude(f"SELECT * FROM {name}"))
        d_cols = [d[0] for d in cur.description]
        assert d_cols == df.columns
        assert multiset(df.columns, s_rows) == multiset(d_cols, cur.fetchall()), name


def test_keys_are_unique(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert set(check_keys(derive_shop_tables(events)).values()) == {0}
