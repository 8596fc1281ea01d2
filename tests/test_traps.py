"""Hand-made cases of FIXTURES.md §4: bounds (T4), zero denominators (T2),
bounces, product funnels (T10, T11), cross-sell fan-out (T9), next page,
repeats (T12)."""

import datetime as dt
from decimal import Decimal

from funnelwise.functions.ranges import before, between, half_open, open_range
from funnelwise.operators import funnel, pages, product, retention, traffic
from funnelwise.sources.schema import (ORDER_ITEM_REFUNDS, ORDER_ITEMS, WEB_ORDERS, WEBSITE_PAGEVIEWS,
                                       WEBSITE_SESSIONS)


def ts(s):
    return dt.datetime.fromisoformat(s)


def sessions_df(spark, rows):
    # (id, created_at, user, repeat, source, campaign, device, referer)
    return spark.createDataFrame([(i, ts(t), u, r, s, c, d, ref) for i, t, u, r, s, c, d, ref in rows],
                                 WEBSITE_SESSIONS)


def pv_df(spark, rows):
    # (pageview id, created_at, session, url)
    return spark.createDataFrame([(i, ts(t), s, u) for i, t, s, u in rows], WEBSITE_PAGEVIEWS)


def orders_df(spark, rows):
    # (order id, created_at, session, product, items, price)
    return spark.createDataFrame(
        [(i, ts(t), s, p, n, Decimal(str(price)), Decimal("19.49") * n) for i, t, s, p, n, price in rows], WEB_ORDERS)


def test_strict_and_between_bounds(spark):
    s = sessions_df(spark, [
        (1, "2012-04-15 00:00:00", 1, 0, "gsearch", "nonbrand", "desktop", None),
        (2, "2012-04-15 00:00:01", 2, 0, "gsearch", "nonbrand", "desktop", None),
        (3, "2012-11-15 00:00:00", 3, 0, "gsearch", "nonbrand", "desktop", None),
        (4, "2012-11-15 00:00:01", 4, 0, "gsearch", "nonbrand", "desktop", None),
    ])
    assert [r.website_session_id for r in s.filter(open_range("2012-04-15", "2012-06-09").on()).collect()] == [2]
    kept = {r.website_session_id for r in s.filter(between("2012-09-15", "2012-11-15").on()).collect()}
    assert kept == {3}


def test_refund_rate_zero_denominator_is_null(spark):
    items = spark.createDataFrame([(11, ts("2013-02-01 10:00:00"), 1), (21, ts("2013-02-02 10:00:00"), 1)],
                                  ORDER_ITEMS)
    refunds = spark.createDataFrame([(11,)], ORDER_ITEM_REFUNDS)
    r = product.monthly_refund_rate(items, refunds, before("2014-10-15")).first()
    assert (r.p1_orders, r.p1_refund_rt, r.p2_orders, r.p2_refund_rt) == (2, 0.5, 0, None)


def test_refund_in_two_parts_counts_once(spark):
    items = spark.createDataFrame([(11, ts("2013-02-01 10:00:00"), 1), (21, ts("2013-02-02 10:00:00"), 1)],
                                  ORDER_ITEMS)
    refunds = spark.createDataFrame([(11,), (11,)], ORDER_ITEM_REFUNDS)
    r = product.monthly_refund_rate(items, refunds, before("2014-10-15")).first()
    assert (r.p1_orders, r.p1_refund_rt) == (2, 0.5)


def test_bounce_counts_all_pageviews_and_skips_sessions_without_pages(spark):
    pv = pv_df(spark, [
        (1, "2012-06-01 10:00:00", 1, "/home"),                                      # one page: bounced
        (2, "2012-06-01 11:00:00", 2, "/home"), (3, "2012-06-01 11:05:00", 2, "/products"),
        (4, "2012-06-13 23:59:00", 3, "/lander-1"), (5, "2012-06-14 00:01:00", 3, "/products"),  # 2nd page after cut
    ])
    landing = pages.landing_page(pv, before("2012-06-14"))
    r = pages.bounce_rate(landing).first()
    assert (r.total_sessions, r.bounced_sessions) == (3, 1)
    detail = {x.website_session_id: x.bounced_website_session_id for x in pages.bounce_detail(landing).collect()}
    assert detail == {1: 1, 2: None, 3: None}


def test_session_without_pageviews_forms_null_week(spark):
    s = sessions_df(spark, [(1, "2012-06-05 10:00:00", 1, 0, "gsearch", "nonbrand", "desktop", None),
                            (2, "2012-06-05 11:00:00", 2, 0, "gsearch", "nonbrand", "desktop", None)])
    pv = pv_df(spark, [(1, "2012-06-05 10:00:00", 1, "/home")])
    detail = pages.session_first_page_and_count(s, pv, open_range("2012-06-01", "2012-08-31"),
                                                s.utm_source == "gsearch")
    weeks = {r.week_start_date: r for r in pages.weekly_bounce_and_lander(detail).collect()}
    assert set(weeks) == {dt.date(2012, 6, 5), None}
    assert weeks[None].home_sessions == 0 and weeks[dt.date(2012, 6, 5)].bounce_rate == 1.0


def test_session_with_both_products_is_in_both_funnels(spark):
    pv = pv_df(spark, [
        (1, "2013-02-01 10:00:00", 1, "/the-original-mr-fuzzy"),
        (2, "2013-02-01 10:01:00", 1, "/the-forever-love-bear"),
        (3, "2013-02-01 10:02:00", 1, "/cart"),
    ])
    views = funnel.product_page_views(pv, open_range("2013-01-06", "2013-04-10"),
                                      {"a": "/the-original-mr-fuzzy", "b": "/the-forever-love-bear"})
    flags = funnel.product_session_flags(pv, views, {"/the-original-mr-fuzzy": "mrfuzzy",
                                                     "/the-forever-love-bear": "lovebear"},
                                         {"cart": "/cart", "shipping": "/shipping"}, "guard")
    got = {(r.product_seen, r.cart_made_it, r.shipping_made_it) for r in flags.collect()}
    assert got == {("mrfuzzy", 1, 0), ("lovebear", 1, 0)}


def test_cross_sell_fan_out_is_kept(spark):
    # One session, two cart views, a later page, one order: the reference's
    # joins count the order 4 times and the click-through 4 times.
    pv = pv_df(spark, [
        (1, "2013-09-01 10:00:00", 1, "/cart"),
        (2, "2013-09-01 10:01:00", 1, "/cart"),
        (3, "2013-09-01 10:02:00", 1, "/shipping"),
    ])
    o = orders_df(spark, [(1, "2013-09-01 10:05:00", 1, 1, 1, 50.0)])
    comparison = (between("2013-08-25", "2013-10-25"), "/cart", "2013-09-25", "A", "B")
    r = product.cross_sell(pv, o, *comparison).first()
    assert (r.cart_sessions, r.clickthroughs, r.orders_placed, r.products_purchased) == (1, 4, 4, 4)
    assert r.cart_ctr == 4.0 and r.aov == 50.0 and r.rev_per_cart_session == 200.0
    r = product.cross_sell(pv, o, *comparison, dedupe=True).first()
    assert (r.cart_sessions, r.clickthroughs, r.orders_placed, r.products_purchased) == (1, 1, 1, 1)
    assert r.cart_ctr == 1.0 and r.aov == 50.0 and r.rev_per_cart_session == 50.0


def test_last_products_page_has_null_next_page(spark):
    pv = pv_df(spark, [(1, "2013-02-01 10:00:00", 1, "/products"),
                       (2, "2013-02-02 10:00:00", 2, "/products"), (3, "2013-02-02 10:01:00", 2, "/cart")])
    pages_after = product.next_pageview(pv, open_range("2012-10-06", "2013-04-06"), "/products", "2013-01-06", "A", "B")
    nxt = {r.website_session_id: r.next_pageview_url for r in pages_after.collect()}
    assert nxt == {1: None, 2: "/cart"}
    summary = product.pathing_summary(pages_after, {"to_cart": "/cart"}).first()
    assert (summary.sessions, summary.w_next_pg, summary.to_cart) == (2, 1, 1)


def test_user_without_repeat_counts_as_zero(spark):
    s = sessions_df(spark, [
        (1, "2014-02-01 10:00:00", 10, 0, None, None, "desktop", None),
        (2, "2014-03-01 10:00:00", 10, 1, None, None, "desktop", None),
        (3, "2014-02-01 10:00:00", 20, 0, None, None, "desktop", None),
    ])
    dist = {r.repeat_sessions: r.users for r in retention.repeat_distribution(
        s, half_open("2014-01-01", "2014-11-01")).collect()}
    assert dist == {0: 1, 1: 1}
    pairs = {(r.new_session_id, r.repeat_session_id) for r in retention.new_with_repeats(
        s, half_open("2014-01-01", "2014-11-01")).collect()}
    assert pairs == {(1, 2), (3, None)}


def test_days_to_repeat_use_date_parts(spark):
    s = sessions_df(spark, [
        (1, "2014-05-01 23:59:00", 10, 0, None, None, "desktop", None),
        (2, "2014-05-03 00:01:00", 10, 1, None, None, "desktop", None),
    ])
    r = retention.first_to_second(s, half_open("2014-01-01", "2014-11-03")).first()
    assert r.days_first_to_second_session == 2


def test_conversion_counts_orders_once_per_order(spark):
    s = sessions_df(spark, [(1, "2012-04-01 10:00:00", 1, 0, "gsearch", "nonbrand", "desktop", None),
                            (2, "2012-04-02 10:00:00", 2, 0, "gsearch", "nonbrand", "mobile", None)])
    o = orders_df(spark, [(1, "2012-04-01 11:00:00", 1, 1, 1, 30.0), (2, "2012-04-01 12:00:00", 1, 2, 1, 40.0)])
    r = traffic.conversion(s, o, before("2012-04-14"), rate_col="rate").first()
    assert (r.sessions, r.orders, r.rate) == (2, 2, 1.0)
