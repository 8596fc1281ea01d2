"""Hot keys: one user (and so one session) holding a third of all rows.

* the events -> shop derivation stays exact when a session spans many chunks;
* every statement equals its oracle on such data;
* defining a statement starts no job;
* with broadcasts off and default skew settings (thresholds scaled to the data), joins of
  raw rows are split, and no raw rows are shuffled by session into an aggregate.
"""

import contextlib
import os
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from funnelwise.functions.ranges import half_open
from funnelwise.operators import product, retention
from funnelwise.plans.oracle import ORACLE, STANDALONE
from funnelwise.plans.prelude import with_prelude
from funnelwise.plans.queries import STATEMENTS
from funnelwise.sources.events_fixture import derive_shop_tables
from funnelwise.sources.loader import read_shop_tables, tables_for, write_shop_tables
from tests.shopgen import multiset


def skewed_events(n=6000, seed=3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 1 / 3
    users = np.where(hot, 0, rng.integers(1, 60, size=n))
    # The hot user's events fall in one two-day bucket: one session with a third of all rows.
    secs = np.where(hot, rng.integers(0, 2 * 86400, size=n), rng.integers(0, 29 * 86400, size=n))
    order = np.argsort(secs, kind="stable")
    users, secs = users[order], secs[order]
    return pd.DataFrame({
        "event_id": np.arange(n, dtype="int64"),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(secs, unit="s"),
        "user_id": users.astype("int64"),
        "event_type": "view",
        "value": 1.0,
        "props": [f'{{"k": {int(k)}}}' for k in rng.integers(0, 100, size=n)],
    })


@pytest.fixture(scope="module")
def events_path():
    d = tempfile.mkdtemp(prefix="funnelwise-skew-")
    path = os.path.join(d, "events.parquet")
    skewed_events().to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    return path


def test_derivation_exact_with_hot_user(spark, events_path):
    events = spark.read.parquet(events_path)
    tables = derive_shop_tables(events, chunk=16)        # the hot sessions span many chunks
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events_path}')")
    for name, df in tables.as_dict().items():
        cur = con.execute(with_prelude(f"SELECT * FROM {name}"))
        d_cols = [d[0] for d in cur.description]
        assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(d_cols, cur.fetchall()), name
    hot = tables.pageviews.groupBy("website_session_id").count().agg(F.max("count")).first()[0]
    assert hot > tables.pageviews.count() / 4 and hot > 16 * 4


def shuffled_raw_rows(plan: str) -> list[str]:
    """Session-keyed exchanges that move raw pageview / order rows.

    Exchanges keyed by (session, chunk) are bounded by construction.
    Walks down from each exchange on ``website_session_id`` to the first
    aggregate, scan or exchange.  Fine: an aggregate (rows already combined
    per key, map-side or final) or a scan of ``website_sessions`` (one row per
    session, no hot key).  Raw: a scan of any other table.
    """
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(website_session_id" not in line:
            continue
        if "_chunk" in line.split("ENSURE_REQUIREMENTS")[0]:
            continue  # keyed by (session, chunk): at most ``chunk`` rows per key
        for below in lines[i + 1:]:
            if "Aggregate" in below:
                break
            if "Exchange" in below or "Scan" in below:
                if "Scan" in below and "website_sessions" in below:
                    break
                bad.append(line.strip()[:80] + "  <-  " + below.strip()[:160])
                break
    return bad


# Inner joins of raw rows under fresh shuffles on both sides, which adaptive
# execution splits (tested below).
SPLIT_JOINS = {"next_pageview_id", "next_pageview_url", "product_pathing_pre_post", "cart_sessions_seeing_another_page",
               "funnel_page_flags", "product_funnel_page_flags", "cart_session_orders"}


def test_no_statement_shuffles_raw_rows_into_an_aggregate(spark):
    t = tables_for(spark, "/root/testdata/sf0.001")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "100000"}):
        found = {name: bad for name, fn in STATEMENTS.items()
                 if (bad := shuffled_raw_rows(fn(t)._jdf.queryExecution().executedPlan().toString()))}
    orders_only = {k for k, v in found.items() if all("web_orders" in x for x in v)}  # a session's orders are few
    assert set(found) - orders_only <= SPLIT_JOINS


def test_defining_a_statement_starts_no_job(spark):
    t = tables_for(spark, "/root/testdata/sf0.001")
    sc = spark.sparkContext
    sc.setJobGroup("define", "define")
    try:
        for fn in STATEMENTS.values():
            fn(t)
        assert list(sc.statusTracker().getJobIdsForGroup("define")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@contextlib.contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Default skew handling; sizes scaled to megabytes of data, and partitions as hashed.
SCALED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.files.maxPartitionBytes": "256k",
    "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture(scope="module")
def hot_shop(spark):
    """60,000 events, one session with a third of all pageviews; stored, as joins read files."""
    d = tempfile.mkdtemp(prefix="funnelwise-hot-")
    skewed_events(60_000).to_parquet(f"{d}/events.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    tables = derive_shop_tables(spark.read.parquet(f"{d}/events.parquet"), chunk=1024)
    write_shop_tables(tables, f"{d}/shop", files=16)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet')")
    for name in tables.as_dict():
        con.execute(with_prelude(f"SELECT * FROM {name}").replace("WITH fx_ev", f"CREATE TABLE {name} AS WITH fx_ev", 1))
    return read_shop_tables(spark, f"{d}/shop", keys="check"), con


# Their literal texts pair all pageviews of a session with one another.
PAIRS = {"urls_after_product_page", "product_funnel_page_flags", "product_funnel_session_flags", "product_funnel_counts", "product_funnel_rates"}


@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - PAIRS))
def test_statements_on_a_hot_session(hot_shop, name):
    tables, con = hot_shop
    df = STATEMENTS[name](tables)
    cur = con.execute(STANDALONE[name])
    d_cols = [d[0] for d in cur.description]
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(d_cols, cur.fetchall())


def test_pair_statements_on_a_smaller_hot_session(spark, events_path):
    tables = derive_shop_tables(spark.read.parquet(events_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events_path}')")
    for name in sorted(PAIRS):
        df = STATEMENTS[name](tables)
        cur = con.execute(ORACLE[name])
        d_cols = [d[0] for d in cur.description]
        assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(d_cols, cur.fetchall()), name


def test_next_page_join_is_split(spark, hot_shop):
    tables, _ = hot_shop
    viewed = F.col("pageview_url") == "/products"
    with settings(spark, SCALED):
        df = product.next_page(tables.pageviews, viewed)
        n = df.count()
        df = product.next_page(tables.pageviews, viewed)
        assert len(df.collect()) == n
        assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()


def rows_by_task(df) -> list[int]:
    """How many of the result's rows each task made."""
    def count(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in batches)], pa.int64())})
    return [r.n for r in df.mapInArrow(count, "n bigint").collect()]


@pytest.fixture(scope="module")
def hot_user(spark):
    """300,000 sessions of 2014, a third of them repeat sessions of one user."""
    d = tempfile.mkdtemp(prefix="funnelwise-user-")
    n = spark.range(300_000)
    hot = F.col("id") % 3 == 0
    rows = n.select(
        (F.col("id") + 1).alias("website_session_id"),
        F.expr("timestampadd(SECOND, cast(id * 80 as int), TIMESTAMP_NTZ'2014-01-02 00:00:00')").alias("created_at"),
        F.when(hot, 7).otherwise(F.col("id") % 90_000 + 100).cast("long").alias("user_id"),
        F.when(hot & (F.col("id") > 0), 1).otherwise(((F.col("id") >= 90_000) & ~hot).cast("int")).alias("is_repeat_session"),
        F.lit(None).cast("string").alias("utm_source"), F.lit(None).cast("string").alias("utm_campaign"),
        F.lit("desktop").alias("device_type"), F.lit(None).cast("string").alias("http_referer"))
    rows.repartition(32).write.parquet(f"{d}/website_sessions")  # a skewed partition is split by map tasks
    return spark.read.parquet(f"{d}/website_sessions")


@pytest.mark.parametrize("listing", [lambda s, w: retention.new_with_repeats(s, w), lambda s, w: retention.new_with_repeats(s, w, with_times=True)])
def test_hot_user_is_spread_over_tasks(spark, hot_user, listing):
    with settings(spark, SCALED):
        df = listing(hot_user, half_open("2014-01-01", "2014-12-31"))
        tasks = rows_by_task(df)
    assert sum(tasks) > 100_000
    assert max(tasks) < 0.15 * sum(tasks)


def test_hot_user_new_sessions_are_spread_over_tasks(spark, hot_user):
    """The other way round: the hot user's sessions are new ones, joined to one first repeat."""
    flipped = hot_user.withColumn("is_repeat_session", F.when(F.col("user_id") == 7, (F.col("website_session_id") == 1).cast("int")).otherwise(F.col("is_repeat_session")))
    with settings(spark, SCALED):
        df = retention.first_to_second(flipped, half_open("2014-01-01", "2014-12-31"))
        tasks = rows_by_task(df)
    assert max(tasks) < 0.15 * sum(tasks)
