"""Derivation of the five shop tables from the driver's ``events`` table.

A pure function of ``events``; the same rules are written in DuckDB SQL in
``plans.prelude`` and both produce identical tables.  One session is one
(user, two-day bucket); the event order inside it gives the page sequence.
Time is stretched so January 2024 covers 2012-03 .. 2015-03, the period the
analyses' date literals refer to.

An event of type ``error`` is no pageview, so sessions with only such events have
none; every other event is a pageview, with an id of its own.

Scale notes: events are read twice and shuffled once for the numbering.  A per-(session,
chunk) aggregate (map-side combined) yields the numbering offsets and, by
windows over that small table, each session's id, start and first k.  The
one full shuffle joins events to it on (session, chunk), where no key has
more than ``chunk`` rows, so a user with a third of all events is still
spread over many tasks; the page number is counted inside each chunk.  The
only other window runs over derived users, who have at most three sessions
each by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from funnelwise.functions.sequence import (DEFAULT_CHUNK, OFFSET, chunk_offsets, group_window,
                                          number_in_chunks, with_chunk)
from funnelwise.sources.schema import (
    ORDER_ITEM_REFUNDS,
    ORDER_ITEMS,
    WEB_ORDERS,
    WEBSITE_PAGEVIEWS,
    WEBSITE_SESSIONS,
    ShopTables,
    conform,
)

# Fixed values of the derivation (they must equal the oracle's).
EPOCH_SOURCE = "2024-01-01 00:00:00"
EPOCH_TARGET = "2012-03-19 00:00:00"
TIME_STRETCH = 36
SESSION_BUCKET_DAYS = 2
USER_COHORT_BUCKETS = 3
USERS_PER_SOURCE_USER = 5
NOT_A_PAGEVIEW = "error"
GSEARCH_URL = "https://www.gsearch.com"
BSEARCH_URL = "https://www.bsearch.com"
SOCIALBOOK_URL = "https://www.socialbook.com"
OTHER_URL = "https://www.other.example"
LANDER_LAUNCH = "2012-06-19"
LOVEBEAR_LAUNCH = "2013-01-06"
BILLING2_LAUNCH = "2012-09-10"
CROSS_SELL_LAUNCH = "2013-09-25"
BIRTHDAY_BEAR_LAUNCH = "2013-12-12"
BASE_PRICE = "29.99"
UNIT_COGS = "19.49"


def _ts(literal: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{literal}'")


def _micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def _plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def _source(k: Column) -> Column:
    return (F.when(k < 55, "gsearch").when(k < 74, "bsearch").when(k < 79, "socialbook"))


def _campaign(k: Column) -> Column:
    return (F.when(k < 45, "nonbrand").when(k < 55, "brand").when(k < 70, "nonbrand")
            .when(k < 74, "brand").when(k < 79, "pilot"))


def _referer(k: Column) -> Column:
    return (F.when(k < 55, GSEARCH_URL).when(k < 74, BSEARCH_URL).when(k < 79, SOCIALBOOK_URL)
            .when(k < 89, GSEARCH_URL).when(k < 92, BSEARCH_URL).when(k < 98, F.lit(None))
            .otherwise(OTHER_URL))


def _page_url(stage: Column, sid: Column, s_at: Column) -> Column:
    return (
        F.when(stage == 1, F.when((s_at >= _ts(f"{LANDER_LAUNCH} 00:00:00")) & (sid % 2 == 1), "/lander-1")
               .otherwise("/home"))
        .when(stage == 2, "/products")
        .when(stage == 3, F.when((s_at >= _ts(f"{LOVEBEAR_LAUNCH} 00:00:00")) & (sid % 3 == 0),
                                 "/the-forever-love-bear").otherwise("/the-original-mr-fuzzy"))
        .when(stage == 4, "/cart")
        .when(stage == 5, "/shipping")
        .when(stage == 6, F.when((s_at >= _ts(f"{BILLING2_LAUNCH} 00:00:00")) & ((sid / 2).cast("long") % 2 == 0),
                                 "/billing-2").otherwise("/billing"))
        .when(stage == 7, "/thank-you-for-your-order")
        .otherwise("/products")
    )


def derive_shop_tables(events: DataFrame, chunk: int = DEFAULT_CHUNK,
                       stage: Callable[[str, DataFrame], DataFrame] | None = None) -> ShopTables:
    """Build sessions, pageviews, orders, items and refunds from ``events``.

    ``stage(name, df)`` may store an intermediate result and return it read
    back (``tables_for`` writes it to the shared checkpoint folder), so the
    tables derived from it do not recompute the numbering.
    """
    ev = events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit(EPOCH_SOURCE[:10])))
                / F.lit(SESSION_BUCKET_DAYS)).cast("long").alias("b"),
    )
    group = ["user_id", "b"]
    chunked = with_chunk(ev, "event_id", chunk)

    # One row per (session, chunk): offsets for the numbering, plus the
    # session's id, start and first k, taken over its (few) chunk rows.
    whole = group_window(group)
    offsets = chunk_offsets(
        chunked, group,
        chunk_aggs={"_cmin": F.min("event_id"), "_cts": F.min("ts"), "_ck": F.min_by("k", "event_id")},
        group_values={"sid": F.min("_cmin").over(whole) + 1,
                      "first_ts": F.min("_cts").over(whole),
                      "k1": F.min_by("_ck", "_cmin").over(whole)},
    ).withColumn(
        "s_at",
        _plus_micros(_ts(EPOCH_TARGET), F.lit(TIME_STRETCH) * _micros_between(_ts(EPOCH_SOURCE), F.col("first_ts"))),
    )
    heads = offsets.filter(F.col(OFFSET) == 0).select(*group, "sid", "first_ts", "k1", "s_at")

    rows = number_in_chunks(chunked, offsets, group, "event_id", "n",
                            carry=["sid", "first_ts", "k1", "s_at"]).withColumn(
        "stage", F.when((F.col("sid") % 4 == 0) & (F.col("n") >= 5), F.col("n") - 1).otherwise(F.col("n"))
    )

    sid = F.col("sid")
    new_user = F.col("user_id") * USERS_PER_SOURCE_USER + F.floor(F.col("b") / USER_COHORT_BUCKETS).cast("long")
    # Derived users own at most USER_COHORT_BUCKETS sessions: a tiny window.
    by_user = Window.partitionBy("new_user_id")
    sessions = (
        heads.withColumn("new_user_id", new_user)
        .withColumn("first_sid", F.min("sid").over(by_user))
        .select(
            sid.alias("website_session_id"),
            F.col("s_at").alias("created_at"),
            F.col("new_user_id").alias("user_id"),
            F.when(sid == F.col("first_sid"), 0).otherwise(1).alias("is_repeat_session"),
            _source(F.col("k1")).alias("utm_source"),
            _campaign(F.col("k1")).alias("utm_campaign"),
            F.when(sid % 10 < 7, "desktop").otherwise("mobile").alias("device_type"),
            _referer(F.col("k1")).alias("http_referer"),
        )
    )

    pv_rows = rows.filter(F.col("event_type") != NOT_A_PAGEVIEW).select(
        (F.col("event_id") + 1).alias("website_pageview_id"),
        _plus_micros(F.col("s_at"), _micros_between(F.col("first_ts"), F.col("ts"))).alias("created_at"),
        sid.alias("website_session_id"),
        _page_url(F.col("stage"), sid, F.col("s_at")).alias("pageview_url"),
        "stage",
        "s_at",
        "k1",
    )
    if stage is not None:
        pv_rows = stage("pageview_rows", pv_rows)
    pageviews = pv_rows.select(*WEBSITE_PAGEVIEWS.fieldNames())

    items = F.when((F.col("created_at") >= _ts(f"{CROSS_SELL_LAUNCH} 00:00:00")) & (F.col("website_session_id") % 3 == 1), 2).otherwise(1)
    product = (
        F.when((F.col("s_at") >= _ts(f"{BIRTHDAY_BEAR_LAUNCH} 00:00:00")) & (F.col("website_session_id") % 5 == 0), 3)
        .when((F.col("s_at") >= _ts(f"{LOVEBEAR_LAUNCH} 00:00:00")) & (F.col("website_session_id") % 3 == 0), 2)
        .otherwise(1)
    )
    orders = (
        pv_rows.filter(F.col("stage") == 7)
        .withColumn("items_purchased", items)
        .select(
            F.col("website_session_id").alias("order_id"),
            "created_at",
            "website_session_id",
            product.alias("primary_product_id"),
            "items_purchased",
            (F.col("items_purchased") * (F.expr(f"CAST({BASE_PRICE} AS DECIMAL(4,2))") + F.col("k1"))).cast("decimal(8,2)").alias("price_usd"),
            (F.col("items_purchased") * F.expr(f"CAST({UNIT_COGS} AS DECIMAL(4,2))")).cast("decimal(8,2)").alias("cogs_usd"),
        )
    )
    orders = conform(orders, WEB_ORDERS)

    first_items = orders.select(
        (F.col("order_id") * 10 + 1).alias("order_item_id"), "created_at",
        F.col("primary_product_id").alias("product_id"))
    second_items = orders.filter(F.col("items_purchased") == 2).select(
        (F.col("order_id") * 10 + 2).alias("order_item_id"), "created_at",
        F.lit(4).alias("product_id"))
    order_items = conform(first_items.unionByName(second_items), ORDER_ITEMS)
    refunds = conform(order_items.filter(F.col("order_item_id") % 11 == 0), ORDER_ITEM_REFUNDS)

    return ShopTables(
        sessions=conform(sessions, WEBSITE_SESSIONS),
        pageviews=conform(pageviews, WEBSITE_PAGEVIEWS),
        orders=orders,
        order_items=order_items,
        refunds=refunds,
    )
