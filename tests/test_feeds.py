"""Checked CSV and JSON feeds, collations, results stored by period."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from funnelwise.functions.ranges import before, half_open
from funnelwise.operators import product, traffic
from funnelwise.sources.loader import read_shop_tables, read_text_table, write_periods, write_shop_tables
from funnelwise.sources.schema import SCHEMAS, collated
from tests.shopgen import random_shop, to_spark

REFUNDS, SESSIONS = SCHEMAS["order_item_refunds"], SCHEMAS["website_sessions"]
GOOD = "1,2012-04-01T10:00:00.000,7,0,gsearch,nonbrand,desktop,https://www.gsearch.com"
BAD = ["x1,2012-04-01T10:00:00.000,7,0,gsearch,nonbrand,desktop,", "2,not a time,7,0,,,mobile,", "3,2012-04-01T10:00:00.000,7,0", "4,2012-04-01T10:00:00.000,,0,,,mobile,"]


def feed(tmp_path, lines, name="part.csv"):
    folder = tmp_path / "website_sessions"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_broken_lines_are_an_error_that_names_files(spark, tmp_path):
    path = feed(tmp_path, [GOOD, *BAD], "a.csv")
    feed(tmp_path, [GOOD], "b.csv")
    with pytest.raises(ValueError, match=r"a\.csv \(4\)") as e:
        read_text_table(spark, path, "csv", SESSIONS, {}, "error", None)
    assert "b.csv" not in str(e.value)


def test_broken_lines_are_set_aside(spark, tmp_path):
    path = feed(tmp_path, [GOOD, *BAD])
    aside = str(tmp_path / "aside")
    rows = read_text_table(spark, path, "csv", SESSIONS, {}, "quarantine", aside)
    assert [tuple(r)[:3] for r in rows.collect()] == [(1, dt.datetime(2012, 4, 1, 10), 7)]
    assert rows.select("utm_source").count() == rows.count() == 1  # judged alike whatever is read
    kept = spark.read.parquet(aside).collect()
    assert len(kept) == 4 and {r.record for r in kept} >= set(BAD[:3]) and all(r.file.endswith("part.csv") for r in kept)
    assert read_text_table(spark, path, "csv", SESSIONS, {}, "trust", None).count() == 5
    with pytest.raises(ValueError):
        read_text_table(spark, path, "csv", SESSIONS, {}, "quarantine", None)
    with pytest.raises(ValueError):
        read_text_table(spark, path, "csv", SESSIONS, {}, "drop", None)


def test_json_feed(spark, tmp_path):
    folder = tmp_path / "refunds"
    folder.mkdir()
    (folder / "r.json").write_text('{"order_item_id": 11}\n{"order_item_id": "oops"}\n{"order_item_id": \n{}\n')
    aside = str(tmp_path / "aside")
    assert [r.order_item_id for r in read_text_table(spark, str(folder), "json", REFUNDS, {}, "quarantine", aside).collect()] == [11]
    assert spark.read.parquet(aside).count() == 3


def test_whole_shop_from_csv(spark, tmp_path):
    shop = to_spark(spark, random_shop(6, 40))
    for name, df in shop.as_dict().items():
        df.write.csv(str(tmp_path / "shop" / name))
    with open(tmp_path / "shop" / "web_orders" / "extra.csv", "w") as f:
        f.write("17,2012-05-05T00:00:00.000,1,1,1,cheap,1.00\n")
    with pytest.raises(ValueError, match="extra.csv"):
        read_shop_tables(spark, str(tmp_path / "shop"), "csv", malformed="error")
    t = read_shop_tables(spark, str(tmp_path / "shop"), "csv", malformed="quarantine", quarantine=str(tmp_path / "aside"))
    assert t.orders.count() == shop.orders.count()
    assert spark.read.parquet(str(tmp_path / "aside" / "web_orders")).count() == 1
    a, b = (sorted(map(tuple, traffic.conversion(x.sessions, x.orders, before("2014-01-01"), by=["device_type"]).collect())) for x in (shop, t))
    assert a == b


def test_case_insensitive_text(spark):
    shop = to_spark(spark, random_shop(8, 120))
    mixed = shop.sessions.withColumn("utm_source", F.when(F.col("user_id") % 2 == 0, F.upper("utm_source")).otherwise(F.col("utm_source")))
    import dataclasses
    loose = collated(dataclasses.replace(shop, sessions=mixed), "UTF8_LCASE")
    plain = {r.utm_source: r.sessions for r in traffic.source_breakdown(shop.sessions, before("2016-01-01"), ["utm_source"]).collect()}
    got = {r.utm_source and r.utm_source.lower(): r.sessions for r in traffic.source_breakdown(loose.sessions, before("2016-01-01"), ["utm_source"]).collect()}
    assert got == plain
    assert loose.sessions.filter(F.col("utm_source").isin("gsearch", "bsearch")).count() == shop.sessions.filter(F.col("utm_source").isin("gsearch", "bsearch")).count()
    names = spark.createDataFrame([("GSearch", 1)], "utm_source string, n int").withColumn("utm_source", F.collate("utm_source", "UTF8_LCASE"))
    assert loose.sessions.join(names, "utm_source").count() == plain["gsearch"]
    binary = traffic.source_breakdown(mixed, before("2016-01-01"), ["utm_source"]).count()
    assert binary > len(plain)  # the default stays byte by byte


def test_a_rerun_of_one_month_leaves_the_others_alone(spark, tmp_path):
    shop = to_spark(spark, random_shop(9, 200))
    out = str(tmp_path / "sales")
    write_periods(product.sales_summary(shop.orders, before("2013-01-04")), out, ["yr", "mo"])

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(out) for f in names if f.endswith(".parquet")}

    first = files()
    write_periods(product.sales_summary(shop.orders, half_open("2012-09-01", "2012-10-01")), out, ["yr", "mo"])
    second = files()
    assert {f for f in first if f not in second} == {f for f in first if "mo=9" in f and "yr=2012" in f} != set()
    assert all(second[f] == first[f] for f in first if f in second)
    want = product.sales_summary(shop.orders, before("2013-01-04"))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_landing_page_without_counts_reads_the_window_only(spark, tmp_path):
    from funnelwise.operators import pages
    from tests.test_plans import physical
    write_shop_tables(to_spark(spark, random_shop(2, 60)), str(tmp_path / "s"), files=2)
    views = read_shop_tables(spark, str(tmp_path / "s")).pageviews
    short = pages.landing_page(views, before("2013-06-14"), count_pages=False)
    full = pages.landing_page(views, before("2013-06-14")).drop("n_pages")
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, full.collect()))
    assert "ubquery" not in physical(short) and "LessThan(created_at" in physical(short)
