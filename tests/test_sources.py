"""Stored tables in several formats read back with the fixed schemas and give
the same results as the derived tables."""

import tempfile

import pytest

from funnelwise.plans.queries import STATEMENTS
from funnelwise.sources.loader import read_shop_tables, tables_for, write_shop_tables
from funnelwise.sources.schema import SCHEMAS
from tests.shopgen import multiset

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_round_trip_formats(spark, fmt):
    t = tables_for(spark, SF)
    root = tempfile.mkdtemp(prefix=f"funnelwise-{fmt}-")
    options = {"header": "true"} if fmt == "csv" else {}
    for name, df in t.as_dict().items():
        df.write.format(fmt).options(**options).save(f"{root}/{name}")
    back = read_shop_tables(spark, root, fmt, options)
    for name, df in back.as_dict().items():
        assert df.schema == SCHEMAS[name] or [f.dataType for f in df.schema] == [f.dataType for f in SCHEMAS[name]]
    for name in ("quarterly_efficiency", "cross_sell_pre_post", "product_funnel_page_flags"):
        a, b = STATEMENTS[name](t), STATEMENTS[name](back)
        assert multiset(a.columns, [tuple(r) for r in a.collect()]) == multiset(b.columns, [tuple(r) for r in b.collect()])


def test_written_tables_are_time_clustered(spark):
    t = tables_for(spark, SF)
    root = tempfile.mkdtemp(prefix="funnelwise-cluster-")
    write_shop_tables(t, root, files=4)
    back = spark.read.parquet(f"{root}/website_pageviews")
    from pyspark.sql import functions as F
    spans = (back.groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).orderBy("lo").collect())
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))


def test_catalog_tables(spark):
    t = tables_for(spark, SF)
    root = tempfile.mkdtemp(prefix="funnelwise-catalog-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS funnelwise_test LOCATION '{root}'")
    for name, df in t.as_dict().items():
        df.write.mode("overwrite").saveAsTable(f"funnelwise_test.{name}")
    back = read_shop_tables(spark, "funnelwise_test", "table")
    a, b = STATEMENTS["quarterly_volume"](t), STATEMENTS["quarterly_volume"](back)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_register_views_for_sql(spark):
    t = tables_for(spark, SF)
    t.register_views(prefix="fw_")
    got = spark.sql("""
        SELECT year(s.created_at) AS yr, quarter(s.created_at) AS qtr,
               count(DISTINCT s.website_session_id) AS sessions, count(DISTINCT o.order_id) AS orders
        FROM fw_website_sessions s LEFT JOIN fw_web_orders o ON s.website_session_id = o.website_session_id
        GROUP BY 1, 2""")
    want = STATEMENTS["quarterly_volume"](t)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_time_window_skips_most_row_groups(spark):
    import pyarrow.parquet as pq
    import datetime as dt
    t = tables_for(spark, "/root/testdata/sf0.01")
    lo, hi = dt.datetime(2012, 8, 5), dt.datetime(2012, 9, 5)
    total = overlapping = 0
    for f in t.pageviews.inputFiles():
        md = pq.ParquetFile(f.replace("file:", "")).metadata
        col = [i for i in range(md.num_columns) if md.schema.column(i).name == "created_at"][0]
        for g in range(md.num_row_groups):
            stats = md.row_group(g).column(col).statistics
            total += 1
            overlapping += int(stats.min < hi and stats.max > lo)
    assert total >= 4 and overlapping <= total // 4


def test_repeated_keys(spark):
    t = tables_for(spark, SF)
    root = tempfile.mkdtemp(prefix="funnelwise-keys-")
    doubled = {"website_sessions", "website_pageviews", "web_orders", "order_items"}
    for name, df in t.as_dict().items():
        (df.unionByName(df) if name in doubled else df).write.parquet(f"{root}/{name}")
    with pytest.raises(ValueError, match="website_sessions.website_session_id"):
        read_shop_tables(spark, root, keys="check")
    with pytest.raises(ValueError):
        read_shop_tables(spark, root, keys="maybe")
    once = read_shop_tables(spark, root, keys="dedupe")
    for name in ("quarterly_volume", "top_pages", "bounce_rate", "monthly_refund_rate", "cross_sell_pre_post"):
        a, b = STATEMENTS[name](t), STATEMENTS[name](once)
        assert multiset(a.columns, [tuple(r) for r in a.collect()]) == multiset(b.columns, [tuple(r) for r in b.collect()])
    assert read_shop_tables(spark, root, keys="trust").sessions.count() == 2 * t.sessions.count()


def test_instants_are_read_in_the_source_zone_whatever_the_session(spark):
    t = tables_for(spark, SF)
    root = tempfile.mkdtemp(prefix="funnelwise-zone-")
    old = spark.conf.get("spark.sql.session.timeZone")
    for name, df in t.as_dict().items():
        if "created_at" in df.columns:
            from pyspark.sql import functions as F
            df = df.withColumn("created_at", F.expr("cast(created_at as timestamp)"))  # the session is in UTC here
        df.write.parquet(f"{root}/{name}")
    want = sorted(map(tuple, t.sessions.collect()), key=repr)
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(map(tuple, read_shop_tables(spark, root).sessions.collect()), key=repr) == want
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        shifted = read_shop_tables(spark, root, source_zone="America/New_York").sessions
        assert shifted.join(t.sessions.withColumnRenamed("created_at", "utc").select("website_session_id", "utc"), "website_session_id").filter(
            "timestampdiff(MINUTE, created_at, utc) NOT IN (240, 300)").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_database_options():
    from funnelwise.sources.loader import jdbc_options
    given = {"url": "jdbc:mysql://host/shop", "numPartitions": "8", "website_pageviews.lowerBound": "1", "website_pageviews.upperBound": "900"}
    assert jdbc_options("website_pageviews", "shop", given) == {
        "url": "jdbc:mysql://host/shop", "numPartitions": "8", "dbtable": "shop.website_pageviews", "lowerBound": "1", "upperBound": "900",
        "partitionColumn": "website_pageview_id"}
    assert jdbc_options("order_item_refunds", "", given) == {"url": "jdbc:mysql://host/shop", "dbtable": "order_item_refunds"}
