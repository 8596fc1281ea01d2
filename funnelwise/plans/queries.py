"""The 65 statements of the analysis, as operator calls with its literals, and further
ones (``FURTHER``) of the general operators.

Each entry is ``name -> f(tables) -> DataFrame``; ``spark_queries()`` wraps
them as ``(spark, sf_dir) -> DataFrame`` over the tables derived from that
"""

from __future__ import annotations

import dataclasses
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelwise.functions.columns import GUARD_LABEL, channel_group
from funnelwise.functions.ranges import before, between, everything, half_open, open_range
from funnelwise.operators import distinct, funnel, growth, pages, product, retention, seasonality, traffic
from funnelwise.session import checkpoint_dir, remove_at_exit
from funnelwise.sources.loader import read_text_table, tables_for, write_periods
from funnelwise.sources.schema import SCHEMAS, ShopTables, collated

# Urls, labels and segment values used by the analysis.
HOME = "/home"
LANDER = "/lander-1"
PRODUCTS = "/products"
MRFUZZY = "/the-original-mr-fuzzy"
LOVEBEAR = "/the-forever-love-bear"
CART = "/cart"
SHIPPING = "/shipping"
BILLING = "/billing"
BILLING2 = "/billing-2"
THANKYOU = "/thank-you-for-your-order"

SITE_FUNNEL = {"products": PRODUCTS, "mrfuzzy": MRFUZZY, "cart": CART, "shipping": SHIPPING,
               "billing": BILLING, "thankyou": THANKYOU}
SITE_FUNNEL_PAGE_FLAGS = {f"{k}_page": v for k, v in SITE_FUNNEL.items()}
PRODUCT_STEPS = {"cart": CART, "shipping": SHIPPING, "billing": BILLING2, "thankyou": THANKYOU}
PRODUCT_LABELS = {MRFUZZY: "mrfuzzy", LOVEBEAR: "lovebear"}

PRE_PRODUCT_2 = ("A. Pre_Product_2", "B. Pre_Product_2")
CROSS_SELL = ("A. Pre_Cross_Sell", "B. Post_Cross_Sell")
BIRTHDAY_BEAR = ("A. Pre_Birthday_Bear", "B. Post_Birthday_Bear")


def _gsearch_nonbrand():
    return (F.col("utm_source") == "gsearch") & (F.col("utm_campaign") == "nonbrand")


def _nonbrand():
    return F.col("utm_campaign") == "nonbrand"


# --- reusable intermediate results (the reference's temporary tables) -------

_SHARED_LOCK = threading.RLock()  # re-entrant: intermediates build on intermediates


def shared(name: str, *parameters: object) -> Callable[[Callable[[ShopTables], DataFrame]], Callable[[ShopTables], DataFrame]]:
    """Mark an intermediate result that several statements read (``name``: the statement
    that returns it, or of its first use; ``parameters``: its literals).

    With ``tables.scratch`` set it is a snapshot there, which every user reads (a
    temporary table); otherwise it is built inside each statement's plan.
    """
    def wrap(build: Callable[[ShopTables], DataFrame]) -> Callable[[ShopTables], DataFrame]:
        def get(t: ShopTables) -> DataFrame:
            with _SHARED_LOCK:
                return t.temporary_table(name, parameters, lambda: build(t))
        get.__name__ = build.__name__
        return get
    return wrap


@shared("landing_sessions", "2012-06-14")
def _landing(t: ShopTables) -> DataFrame:                      # Q10 with page counts (Q09 window)
    return pages.landing_page(t.pageviews, before("2012-06-14"))


def _lander_first_id(t: ShopTables):                           # Q14 -> Q15 threshold
    return pages.first_seen(t.pageviews, LANDER).select("first_pageview_id").scalar()


@shared("ab_first_test_pageview", LANDER, "2012-07-28", "gsearch", "nonbrand")
def _ab_first(t: ShopTables) -> DataFrame:                     # Q15 (+ landing url)
    segment = traffic.sessions_in(t.sessions, before("2012-07-28"), _gsearch_nonbrand())
    return pages.landing_page(t.pageviews, min_id=_lander_first_id(t), sessions=segment)


@shared("ab_sessions_w_landing_page", HOME, LANDER, "2012-07-28", "gsearch", "nonbrand")
def _ab_landing(t: ShopTables) -> DataFrame:                   # Q16
    return _ab_first(t).filter(F.col("landing_page").isin(HOME, LANDER))


@shared("session_lander_and_time", "2012-06-01", "2012-08-31", "gsearch", "nonbrand")
def _trend_detail(t: ShopTables) -> DataFrame:                 # Q21
    return pages.session_first_page_and_count(t.sessions, t.pageviews, open_range("2012-06-01", "2012-08-31"),
                                              _gsearch_nonbrand())


@shared("funnel_session_flags", "2012-08-05", "2012-09-05", "gsearch", "nonbrand", SITE_FUNNEL)
def _funnel_flags(t: ShopTables) -> DataFrame:                 # Q24
    return funnel.session_flags(t.sessions, t.pageviews, open_range("2012-08-05", "2012-09-05"),
                                _gsearch_nonbrand(), SITE_FUNNEL)


def _billing_views(t: ShopTables) -> DataFrame:                # Q28, Q29 (from the first view, Q27)
    return pages.page_views_of_test(t.pageviews, pages.after_first_seen(t.pageviews, BILLING2, strict=False),
                                    before("2012-11-10"), [BILLING, BILLING2])


_PRODUCTS_PERIODS = (open_range("2012-10-06", "2013-04-06"), PRODUCTS, "2013-01-06", *PRE_PRODUCT_2)
_CART_PERIODS = (between("2013-08-25", "2013-10-25"), CART, "2013-09-25", *CROSS_SELL)
_PRODUCT_WINDOW = open_range("2013-01-06", "2013-04-10")


@shared("products_pageviews", _PRODUCTS_PERIODS)
def _products_views(t: ShopTables) -> DataFrame:               # Q39
    return product.labelled_views(t.pageviews, *_PRODUCTS_PERIODS)


@shared("next_pageview_url", _PRODUCTS_PERIODS)
def _next_pages(t: ShopTables) -> DataFrame:                   # Q40 + Q41
    return product.next_pageview(t.pageviews, *_PRODUCTS_PERIODS)


@shared("sessions_seeing_product_pages", _PRODUCT_WINDOW, PRODUCT_LABELS)
def _product_views(t: ShopTables) -> DataFrame:                # Q43
    return funnel.product_page_views(t.pageviews, _PRODUCT_WINDOW, {"mrfuzzy": MRFUZZY, "lovebear": LOVEBEAR})


@shared("product_funnel_session_flags", _PRODUCT_WINDOW, PRODUCT_LABELS, PRODUCT_STEPS, GUARD_LABEL)
def _product_flags(t: ShopTables) -> DataFrame:                # Q46
    return funnel.product_session_flags(t.pageviews, _product_views(t), PRODUCT_LABELS, PRODUCT_STEPS,
                                        GUARD_LABEL)


@shared("sessions_seeing_cart", _CART_PERIODS)
def _carts(t: ShopTables) -> DataFrame:                        # Q49
    return product.cart_views(t.pageviews, *_CART_PERIODS)


def _in_snapshots(t: ShopTables) -> ShopTables:
    """The tables with their intermediate results stored as snapshots (for this application, unless a folder is set)."""
    if t.scratch is not None:
        return t
    spark = t.sessions.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/funnelwise-snapshots-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, folder)
    return dataclasses.replace(t, scratch=folder)


def _ordered_site_funnel(t: ShopTables) -> DataFrame:
    entries = t.sessions.filter(open_range("2012-08-05", "2012-09-05").on("created_at") & _gsearch_nonbrand()).select("website_session_id")
    return funnel.ordered_funnel(entries, t.pageviews, SITE_FUNNEL)


def _ordered_product_funnel(t: ShopTables) -> DataFrame:
    entries = funnel.product_entries(_product_views(t), PRODUCT_LABELS, GUARD_LABEL)
    return funnel.ordered_funnel(entries, t.pageviews, PRODUCT_STEPS, by=["product_seen"], after="entry_pageview_id")


def _folder(t: ShopTables, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, removed when the application ends."""
    spark = t.sessions.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/funnelwise-{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def _checked_feed(t: ShopTables) -> DataFrame:
    """A CSV feed of the sessions in which the pageviews' lines got lost: read with a check, weekly counts of what is whole,
    with the number of broken lines."""
    spark, folder = t.sessions.sparkSession, _folder(t, "feed")
    line = lambda df: df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    line(t.sessions).unionByName(line(t.pageviews)).write.text(f"{folder}/website_sessions")
    aside = f"{folder}/broken"
    rows = read_text_table(spark, f"{folder}/website_sessions", "csv", SCHEMAS["website_sessions"], {}, "quarantine", aside)
    broken = spark.read.parquet(aside).agg(F.count("record")).scalar()
    weekly = traffic.trend(rows, "yearweek", {"sessions": F.count("website_session_id")})
    return weekly.withColumn("broken_lines", broken)


def _any_case(t: ShopTables) -> DataFrame:
    """Sessions whose mobile rows are written in capitals, under a case-insensitive collation: conversion per source, and
    the conversion of a source named in small letters."""
    capitals = F.when(F.col("device_type") == "mobile", F.upper("utm_source")).otherwise(F.col("utm_source"))
    mixed = dataclasses.replace(t, sessions=t.sessions.withColumn("utm_source", capitals), scratch=None)
    mixed = collated(mixed, "UTF8_LCASE")
    by_source = traffic.conversion(mixed.sessions, mixed.orders, before("2012-09-01"), F.col("utm_source").isin("gsearch", "bsearch"), by=["utm_source"])
    return by_source.withColumn("utm_source", F.lower(F.col("utm_source")).cast("string"))


def _sales_by_period(t: ShopTables) -> DataFrame:
    """Monthly sales, stored by month; one quarter is run again on top of the stored ones."""
    folder = _folder(t, "sales")
    write_periods(product.sales_summary(t.orders, before("2013-01-04")), folder, ["yr", "mo"])
    write_periods(product.sales_summary(t.orders, half_open("2012-07-01", "2012-10-01")), folder, ["yr", "mo"])
    return t.orders.sparkSession.read.parquet(folder)


# Distinct sessions among the pageviews, and distinct users among the sessions: both repeat.

def _unique_visits(t: ShopTables, grain: str) -> DataFrame:
    url = F.col("pageview_url")
    measures = {"sessions": None, "product_sessions": url.isin(MRFUZZY, LOVEBEAR), "cart_sessions": url == CART, "thankyou_sessions": url == THANKYOU}
    return distinct.roll_up(distinct.daily_bitmaps(t.pageviews, "website_session_id", measures), list(measures), distinct.grain_keys(grain))


def _unique_users(t: ShopTables, grain: str) -> DataFrame:
    device = F.col("device_type")
    measures = {"users": None, "desktop_users": device == "desktop", "mobile_users": device == "mobile", "nonbrand_users": _nonbrand()}
    return distinct.roll_up(distinct.daily_bitmaps(t.sessions, "user_id", measures), list(measures), distinct.grain_keys(grain))


def _quarter_channels():
    src, camp, ref = F.col("utm_source"), F.col("utm_campaign"), F.col("http_referer")
    return {
        "gsearch_nonbrand_orders": (src == "gsearch") & (camp == "nonbrand"),
        "bsearch_nonbrand_orders": (src == "bsearch") & (camp == "nonbrand"),
        "brand_search_orders": camp == "brand",
        "organic_search_orders": src.isNull() & ref.isNotNull(),
        "direct_type_in_orders": src.isNull() & ref.isNull(),
    }


# Beyond the 65: the general operators on rows that repeat their keys, on steps in order, on snapshots.
FURTHER: dict[str, Callable[[ShopTables], DataFrame]] = {
    "cross_sell_pre_post_dedupe": lambda t: product.cross_sell(t.pageviews, t.orders, *_CART_PERIODS, dedupe=True),
    "weekly_unique_visits": lambda t: _unique_visits(t, "week"),
    "monthly_unique_visits": lambda t: _unique_visits(t, "month"),
    "quarterly_unique_users": lambda t: _unique_users(t, "quarter"),
    "unique_users_by_device_source": lambda t: distinct.distinct_counts(
        t.sessions, "user_id", {"users": None, "repeat_users": F.col("is_repeat_session") == 1}, ["device_type", "utm_source"]),
    "ordered_funnel_counts": lambda t: funnel.step_counts(_ordered_site_funnel(t), list(SITE_FUNNEL)),
    "ordered_product_funnel_counts": lambda t: funnel.step_counts(_ordered_product_funnel(t), list(PRODUCT_STEPS), by=["product_seen"]),
    "weekly_sessions_checked_feed": _checked_feed,
    "conversion_by_source_any_case": _any_case,
    "monthly_sales_by_period": _sales_by_period,
    "bounce_rate_from_snapshot": lambda t: pages.bounce_rate(_landing(_in_snapshots(t))),
}

STATEMENTS: dict[str, Callable[[ShopTables], DataFrame]] = {
    # Part I: traffic sources
    "traffic_top_sources": lambda t: traffic.source_breakdown(t.sessions, before("2012-04-12")),
    "source_conversion_rate": lambda t: traffic.conversion(
        t.sessions, t.orders, before("2012-04-14"), _gsearch_nonbrand(),
        rate_col="session_to_order_conv_rate"),
    "weekly_sessions": lambda t: traffic.weekly_sessions(t.sessions, before("2012-05-10"), _gsearch_nonbrand()),
    "conversion_by_device": lambda t: traffic.conversion(
        t.sessions, t.orders, before("2012-05-11"), _gsearch_nonbrand(), by=["device_type"], rate_col="conv_rt"),
    "weekly_sessions_by_device": lambda t: traffic.weekly_device_sessions(
        t.sessions, open_range("2012-04-15", "2012-06-09"), _gsearch_nonbrand()),

    # Part II: website performance
    "top_pages": lambda t: pages.page_views(t.pageviews, before("2012-06-09")),
    "first_pv_per_session": lambda t: pages.first_pageview(t.pageviews, before("2012-06-12"), "first_pv"),
    "top_entry_pages": lambda t: pages.entry_page_counts(t.pageviews, before("2012-06-12")),
    "first_pageviews": lambda t: pages.first_pageview(t.pageviews, before("2012-06-14"), "min_pageview_id"),
    "sessions_w_landing_page": lambda t: pages.landing_page(t.pageviews, before("2012-06-14"), count_pages=False).select(
        "website_session_id", "landing_page"),
    "bounced_sessions": lambda t: pages.bounced_sessions(_landing(t)),
    "session_bounce_detail": lambda t: pages.bounce_detail(_landing(t)),
    "bounce_rate": lambda t: pages.bounce_rate(_landing(t)),
    "page_first_seen": lambda t: pages.first_seen(t.pageviews, LANDER),
    "ab_first_test_pageview": lambda t: _ab_first(t).select(
        "website_session_id", F.col("first_pageview_id").alias("min_pageview_id")),
    "ab_sessions_w_landing_page": lambda t: _ab_landing(t).select("website_session_id", "landing_page"),
    "ab_bounced_sessions": lambda t: pages.bounced_sessions(_ab_landing(t)),
    "ab_session_detail": lambda t: pages.bounce_detail(_ab_landing(t), keep=["landing_page"]),
    "ab_bounce_rate": lambda t: pages.ab_test(_ab_landing(t), "landing_page", (F.col("n_pages") == 1).cast("int"),
                                              ("sessions", "bounced_sessions", "bounce_rate")),
    "session_first_pv_and_count": lambda t: _trend_detail(t).select(
        "website_session_id", "first_pageview_id", "count_pageviews"),
    "session_lander_and_time": _trend_detail,
    "weekly_bounce_and_lander": lambda t: pages.weekly_bounce_and_lander(_trend_detail(t), HOME, LANDER),
    "funnel_page_flags": lambda t: funnel.page_flags(
        t.sessions, t.pageviews, open_range("2012-08-05", "2012-09-05"), _gsearch_nonbrand(),
        SITE_FUNNEL_PAGE_FLAGS),
    "funnel_session_flags": _funnel_flags,
    "funnel_counts": lambda t: funnel.step_counts(_funnel_flags(t), list(SITE_FUNNEL)),
    "funnel_click_rates": lambda t: funnel.step_rates(
        funnel.step_counts(_funnel_flags(t), list(SITE_FUNNEL)), list(SITE_FUNNEL),
        ["lander_clickthrough_rate", "products_clickthrough_rate", "mr_fuzzy_clickthrough_rate",
         "cart_clickthrough_rate", "shipping_clickthrough_rate", "billing_clickthrough_rate"],
        keep=["sessions"]),
    "billing_first_pv": lambda t: t.pageviews.filter(F.col("pageview_url") == BILLING2).agg(
        F.min("website_pageview_id").alias("first_pv_id")),
    "billing_sessions_detail": lambda t: pages.billing_sessions(_billing_views(t), t.orders),
    "billing_ab_conversion": lambda t: pages.billing_conversion(_billing_views(t), t.orders),

    # Part III: channel portfolio
    "weekly_channel_sessions": lambda t: traffic.weekly_channel_sessions(
        t.sessions, open_range("2012-08-22", "2012-11-29"), _nonbrand()),
    "channel_mobile_share": lambda t: traffic.channel_mobile_share(
        t.sessions, open_range("2012-08-22", "2012-11-30"), _nonbrand()),
    "conversion_by_device_source": lambda t: traffic.conversion(
        t.sessions, t.orders, open_range("2012-08-22", "2012-09-19"), _nonbrand(),
        by=["device_type", "utm_source"], rate_col="conv_rate"),
    "weekly_source_device_mix": lambda t: traffic.weekly_source_device_mix(
        t.sessions, open_range("2012-11-04", "2012-12-22"), _nonbrand()),
    "monthly_channel_mix": lambda t: traffic.monthly_channel_mix(
        t.sessions, before("2012-12-23"), channel_group(with_social=False)),

    # Part IV: seasonality
    "weekly_seasonality": lambda t: seasonality.weekly_seasonality(t.sessions, t.orders, before("2013-01-01")),
    "hour_weekday_heatmap": lambda t: seasonality.hour_weekday_heatmap(
        t.sessions, between("2012-09-15", "2012-11-15")),

    # Part V: products
    "monthly_sales": lambda t: product.sales_summary(t.orders, before("2013-01-04")),
    "product_launch": lambda t: product.launch_summary(
        t.sessions, t.orders, open_range("2012-04-01", "2013-04-05"),
        {"product_one_orders": 1, "product_two_orders": 2}),
    "products_pageviews": lambda t: _products_views(t).select(
        "website_session_id", "website_pageview_id", "created_at", "time_period"),
    "next_pageview_id": lambda t: _next_pages(t).select(
        "time_period", "website_session_id", F.col("next_pageview_id").alias("min_next_pageview_id")),
    "next_pageview_url": lambda t: _next_pages(t).select("time_period", "website_session_id",
                                                         "next_pageview_url"),
    "product_pathing_pre_post": lambda t: product.pathing_summary(
        _next_pages(t), {"to_mrfuzzy": MRFUZZY, "to_lovebear": LOVEBEAR}),
    "sessions_seeing_product_pages": _product_views,
    "urls_after_product_page": lambda t: funnel.urls_after(t.pageviews, _PRODUCT_WINDOW, [MRFUZZY, LOVEBEAR]),
    "product_funnel_page_flags": lambda t: funnel.product_page_flag_counts(
        t.pageviews, _PRODUCT_WINDOW, [MRFUZZY, LOVEBEAR], PRODUCT_STEPS),
    "product_funnel_session_flags": _product_flags,
    "product_funnel_counts": lambda t: funnel.step_counts(_product_flags(t), list(PRODUCT_STEPS),
                                                          by=["product_seen"]),
    "product_funnel_rates": lambda t: funnel.step_rates(
        funnel.step_counts(_product_flags(t), list(PRODUCT_STEPS), by=["product_seen"]), list(PRODUCT_STEPS),
        ["product_page_click_rt", "cart_click_rt", "shipping_click_rt", "billing_click_rt"],
        keep=["product_seen"]),
    "sessions_seeing_cart": _carts,
    "cart_sessions_seeing_another_page": lambda t: product.cart_clickthroughs(t.pageviews, *_CART_PERIODS),
    "cart_session_orders": lambda t: product.cart_orders(_carts(t), t.orders),
    "cross_sell_pre_post": lambda t: product.cross_sell(t.pageviews, t.orders, *_CART_PERIODS),
    "portfolio_pre_post": lambda t: product.portfolio_pre_post(
        t.sessions, t.orders, between("2013-11-22", "2014-01-22"), "2013-12-22", *BIRTHDAY_BEAR),
    "monthly_refund_rate": lambda t: product.monthly_refund_rate(t.order_items, t.refunds, before("2014-10-15")),

    # Part VI: users
    "sessions_w_repeats": lambda t: retention.new_with_repeats(t.sessions, half_open("2014-01-01", "2014-11-01")),
    "repeat_session_distribution": lambda t: retention.repeat_distribution(
        t.sessions, half_open("2014-01-01", "2014-11-01")),
    "repeats_for_time_diff": lambda t: retention.new_with_repeats(
        t.sessions, half_open("2014-01-01", "2014-11-03"), with_times=True),
    "users_first_to_second": lambda t: retention.first_to_second(t.sessions, half_open("2014-01-01", "2014-11-03")),
    "time_to_repeat": lambda t: retention.time_to_repeat(
        retention.first_to_second(t.sessions, half_open("2014-01-01", "2014-11-03"))),
    "repeat_by_source": lambda t: retention.repeat_by_source(t.sessions, half_open("2014-01-01", "2014-11-05")),
    "repeat_by_channel": lambda t: retention.repeat_by_channel(t.sessions, half_open("2014-01-01", "2014-11-05")),
    "new_vs_repeat_conversion": lambda t: retention.new_vs_repeat_conversion(
        t.sessions, t.orders, half_open("2014-01-01", "2014-11-08")),

    # Part VII: final outcome
    "quarterly_volume": lambda t: growth.quarterly_volume(t.sessions, t.orders, everything()),
    "quarterly_efficiency": lambda t: growth.quarterly_efficiency(t.sessions, t.orders, everything()),
    "quarterly_channel_orders": lambda t: growth.quarterly_channel_orders(t.sessions, t.orders,
                                                                          _quarter_channels()),
    **FURTHER,
}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``name -> (spark, sf_dir) -> DataFrame`` over the tables derived from ``sf_dir``."""
    def bind(fn: Callable[[ShopTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(tables_for(spark, sf_dir))
    return {name: bind(fn) for name, fn in STATEMENTS.items()}
