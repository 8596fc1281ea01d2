"""The general operators on other dates, pages and grains than the statements use."""

import datetime as dt

from pyspark.sql import functions as F

from funnelwise.functions.ranges import between, everything, open_range
from funnelwise.operators import funnel, pages, product, retention, traffic
from tests.test_traps import orders_df, pv_df, sessions_df


def pv(spark):
    return pv_df(spark, [
        (1, "2020-01-01 10:00:00", 1, "/a"), (2, "2020-01-01 10:01:00", 1, "/b"), (3, "2020-01-01 10:02:00", 1, "/a"), (4, "2020-01-01 10:03:00", 1, "/c"),
        (5, "2020-01-02 10:00:00", 2, "/b"), (6, "2020-01-02 10:01:00", 2, "/a"),
        (7, "2020-02-01 10:00:00", 3, "/c"),
    ])


def test_landing_page(spark):
    rows = {r.website_session_id: tuple(r)[1:] for r in pages.landing_page(pv(spark)).collect()}
    assert rows[1] == ("/a", 1, dt.datetime(2020, 1, 1, 10), 4) and rows[3] == ("/c", 7, dt.datetime(2020, 2, 1, 10), 1)
    later = pages.landing_page(pv(spark), between("2020-01-01", "2020-01-31"), urls=["/b", "/a"], min_id=F.lit(2))
    assert {(r.website_session_id, r.landing_page, r.n_pages) for r in later.collect()} == {(1, "/a", 4), (2, "/b", 2)}
    of = pages.landing_page(pv(spark), sessions=spark.createDataFrame([(2,), (9,)], "website_session_id long"))
    assert [(r.website_session_id, r.landing_page) for r in of.collect()] == [(2, "/b")]


def test_next_page_by_day_and_without_unmatched(spark):
    got = product.next_page(pv(spark), F.col("pageview_url") == "/a", {"day": F.to_date("created_at")})
    assert {(str(r.day), r.website_session_id, r.next_pageview_id, r.next_pageview_url) for r in got.collect()} == {
        ("2020-01-01", 1, 2, "/b"), ("2020-01-02", 2, None, None)}
    assert product.next_page(pv(spark), F.col("pageview_url") == "/a", keep_unmatched=False).count() == 1


def test_funnel_with_and_without_an_entry(spark):
    steps = {"b": "/b", "c": "/c"}
    sessions = spark.createDataFrame([(1, "x"), (2, "y"), (9, "y")], "website_session_id long, kind string")
    plain = {tuple(r) for r in funnel.funnel(sessions, pv(spark), steps, by=["kind"]).collect()}
    assert plain == {(1, "x", 1, 1), (2, "y", 1, 0), (9, "y", 0, 0)}
    entries = spark.createDataFrame([(1, 2), (2, 5)], "website_session_id long, start long")
    assert {tuple(r) for r in funnel.funnel(entries, pv(spark), steps, after="start").collect()} == {(1, 0, 1), (2, 0, 0)}
    counts = funnel.step_counts(funnel.funnel(sessions, pv(spark), steps, by=["kind"]), ["b", "c"], by=["kind"])
    assert {tuple(r) for r in counts.collect()} == {("x", 1, 1, 1), ("y", 2, 1, 0)}


def test_urls_after(spark):
    got = funnel.urls_after(pv(spark), everything(), ["/a"])
    assert {r.pageview_url for r in got.collect()} == {"/a", "/b", "/c", None}


def test_ab_test_from_first_seen(spark):
    seen = pages.page_views_of_test(pv(spark), pages.after_first_seen(pv(spark), "/b"), everything(), ["/a", "/b"])
    assert {tuple(r) for r in seen.collect()} == {(1, "/a"), (2, "/b"), (2, "/a")}
    inclusive = pages.page_views_of_test(pv(spark), pages.after_first_seen(pv(spark), "/b", strict=False), everything(), ["/a", "/b"])
    assert inclusive.count() == 4
    orders = orders_df(spark, [(1, "2020-01-02 11:00:00", 2, 1, 1, 5.0)])
    got = {r.billing_version_seen: (r.sessions, r.orders, r.billing_to_order_rt) for r in pages.billing_conversion(inclusive, orders).collect()}
    assert got == {"/a": (2, 1, 0.5), "/b": (2, 1, 0.5)}


def test_pre_post_sales_and_new_vs_repeat(spark):
    orders = orders_df(spark, [(1, "2020-01-02 11:00:00", 2, 1, 1, 5.0), (2, "2020-05-02 11:00:00", 3, 1, 1, 7.0)])
    label = F.when(F.col("created_at") < F.expr("TIMESTAMP_NTZ'2020-03-01 00:00:00'"), "before").otherwise("after")
    got = traffic.pre_post(orders, label, {"n": F.count("order_id"), "r": F.sum("price_usd")}, ["n", ("each", "r", "n")])
    assert {tuple(r) for r in got.collect()} == {("before", 1, 5.0), ("after", 1, 7.0)}
    assert {(r.yr, r.qtr, r.number_of_sales) for r in product.sales_summary(orders, open_range("2020-01-01", "2021-01-01"), "quarter").collect()} == {(2020, 1, 1), (2020, 2, 1)}
    s = sessions_df(spark, [(1, "2020-01-01 10:00:00", 1, 0, None, None, "desktop", None), (2, "2020-01-02 10:00:00", 1, 1, None, None, "mobile", None),
                            (3, "2020-01-03 10:00:00", 2, 0, None, None, "mobile", None)])
    assert {tuple(r) for r in retention.new_vs_repeat(s, "device_type").collect()} == {("desktop", 1, 0), ("mobile", 1, 1)}
    two = traffic.conditional_counts({"m": F.col("device_type") == "mobile"}, key="user_id")
    assert s.unionByName(s).agg(two["m"]).first()[0] == 2
