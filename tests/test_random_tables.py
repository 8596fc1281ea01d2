"""Property test: every Spark statement equals the literal SQL on random tables.

The tables contain what the events-derived fixture never has (several orders
per session, repeated product / cart views, several new sessions per user),
so the rewrites (pre-aggregated orders, anchor joins, fan-out arithmetic,
inner + anti join for repeats) are checked against the reference shape.
"""

import pytest

from funnelwise.plans.oracle import STANDALONE
from funnelwise.plans.queries import STATEMENTS
from tests.shopgen import multiset, random_shop, to_duckdb, to_spark


@pytest.fixture(scope="module", params=[(7, 250), (2024, 700)], ids=["sparse", "dense"])
def shop(request, spark):
    seed, users = request.param
    frames = random_shop(seed, users)
    return to_spark(spark, frames), to_duckdb(frames)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement_matches_literal_sql(shop, name):
    tables, con = shop
    df = STATEMENTS[name](tables)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(STANDALONE[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert multiset(df.columns, s_rows) == multiset(d_cols, d_rows)


@pytest.mark.parametrize("chunk", [2, 5])
def test_page_flag_counts_with_tiny_chunks(shop, chunk):
    from funnelwise.functions.ranges import open_range
    from funnelwise.operators import funnel
    from funnelwise.plans import queries as q
    tables, con = shop
    df = funnel.product_page_flag_counts(
        tables.pageviews, open_range("2013-01-06", "2013-04-10"), [q.MRFUZZY, q.LOVEBEAR],
        {"cart": q.CART, "shipping": q.SHIPPING, "billing": q.BILLING2, "thankyou": q.THANKYOU}, chunk=chunk)
    cur = con.execute(STANDALONE["product_funnel_page_flags"])
    d_cols = [d[0] for d in cur.description]
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(d_cols, cur.fetchall())


def test_all_statements_without_broadcasts(spark):
    frames = random_shop(7, 250)
    tables, con = to_spark(spark, frames), to_duckdb(frames)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bad = []
        for name in sorted(STATEMENTS):
            df = STATEMENTS[name](tables)
            cur = con.execute(STANDALONE[name])
            d_cols = [d[0] for d in cur.description]
            if multiset(df.columns, [tuple(r) for r in df.collect()]) != multiset(d_cols, cur.fetchall()):
                bad.append(name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert bad == []
