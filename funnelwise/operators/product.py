"""Product analyses: sales, launches, next-page pathing, cross-sell, portfolio
comparison and refund rates.

"Next pageview after a page of type X" is computed against one anchor per
(period, session): the MIN over all later pageviews of all X views equals
the pageview right after the earliest X view.  Pageviews join their
session's anchors (at most one per period: N:1), so a session with many X
views never pairs them with its later pages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.columns import period_label, safe_ratio, ts_literal
from funnelwise.functions.joins import join_keyed, per_key, rekeyed
from funnelwise.functions.ranges import TimeRange
from funnelwise.operators.traffic import n_orders, n_sessions, pre_post, session_orders, trend

SESSION_ID = "website_session_id"
PAGEVIEW_ID = "website_pageview_id"


def sales_summary(orders: DataFrame, window: TimeRange, grain: str = "month") -> DataFrame:
    """Orders, revenue and margin per time bucket of the order (grains of ``traffic.trend``)."""
    return trend(orders.filter(window.on("created_at")), grain, {
        "number_of_sales": F.count("order_id"),
        "total_revenue": F.sum("price_usd").cast("decimal(18,2)"),
        "total_margin": F.sum(F.col("price_usd") - F.col("cogs_usd")).cast("decimal(18,2)")})


def launch_summary(sessions: DataFrame, orders: DataFrame, window: TimeRange,
                   products: Mapping[str, int]) -> DataFrame:
    """Monthly sessions, orders, conversion, revenue per session and orders per product."""
    so = session_orders(sessions, orders, window, products=list(products.values()))
    monthly = (so.groupBy(F.year("created_at").alias("yr"), F.month("created_at").alias("mo"))
               .agg(n_sessions().alias("sessions"), n_orders().alias("orders"), F.sum("revenue").alias("_rev"),
                    *[F.coalesce(F.sum(f"n_orders_p{p}"), F.lit(0).cast("long")).alias(name)
                      for name, p in products.items()]))
    return monthly.select(
        "yr", "mo", "sessions", "orders", safe_ratio("orders", "sessions").alias("conv_rate"),
        safe_ratio("_rev", "sessions").alias("revenue_per_session"), *products.keys())


def labelled_views(pageviews: DataFrame, window: TimeRange, url: str, cut: str, before: str,
                   after: str) -> DataFrame:
    """Views of ``url`` in the window with a before / after ``cut`` period label."""
    return (pageviews.filter(window.on("created_at") & (F.col("pageview_url") == url))
            .withColumn("time_period", period_label("created_at", cut, before, after)))


def next_page(pageviews: DataFrame, viewed: Column, by: Mapping[str, Column] | None = None,
              keep_unmatched: bool = True) -> DataFrame:
    """Per session (and ``by`` value) with a view that meets ``viewed``: the first pageview after
    its earliest such view.

    Output: the ``by`` columns, website_session_id, next_pageview_id, next_pageview_url
    (NULLs when nothing follows; such rows dropped unless ``keep_unmatched``).
    ``by`` maps column names to expressions over the view, e.g. a period label.
    The joined rows are combined again behind a computed key, so a hot
    session's join can be split and only its combined rows meet.
    """
    by = dict(by or {})
    views = pageviews.filter(viewed)
    keys = [*by, SESSION_ID]
    anchors = (views.select(*[c.alias(n) for n, c in by.items()], SESSION_ID, PAGEVIEW_ID)
               .groupBy(*keys).agg(F.min(PAGEVIEW_ID).alias("_anchor")))
    pv = pageviews.select(SESSION_ID, PAGEVIEW_ID, "pageview_url")
    later = join_keyed(pv, anchors, SESSION_ID, range_of=views).filter(F.col(PAGEVIEW_ID) > F.col("_anchor"))
    nxt = F.min(F.struct(F.col(PAGEVIEW_ID), F.col("pageview_url")))
    following = rekeyed(later, SESSION_ID).groupBy(*keys).agg(nxt.alias("_n"))
    return anchors.join(following, keys, "left" if keep_unmatched else "inner").select(
        *keys, F.col("_n.website_pageview_id").alias("next_pageview_id"),
        F.col("_n.pageview_url").alias("next_pageview_url"))


def next_pageview(pageviews: DataFrame, window: TimeRange, url: str, cut: str, before: str, after: str,
                  keep_unmatched: bool = True) -> DataFrame:
    """``next_page`` of the views of ``url`` in the window, per before / after ``cut`` period."""
    return next_page(pageviews, window.on("created_at") & (F.col("pageview_url") == url),
                     {"time_period": period_label("created_at", cut, before, after)}, keep_unmatched)


def pathing_summary(next_pages: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Per period: sessions, sessions with a next page, and with each target next page."""
    nxt = F.col("next_pageview_url")
    measures = {"sessions": n_sessions(), "w_next_pg": F.count(nxt)}
    measures |= {name: F.count(F.when(nxt == url, F.lit(1))) for name, url in targets.items()}
    columns = ["sessions"]
    for name in ("w_next_pg", *targets):
        columns += [name, (f"pct_{name}", name, "sessions")]
    return pre_post(next_pages, F.col("time_period"), measures, columns)


def cart_views(pageviews: DataFrame, window: TimeRange, url: str, cut: str, before: str,
               after: str) -> DataFrame:
    """Cart pageviews in the window: time_period, cart_session_id, cart_pageview_id."""
    return labelled_views(pageviews, window, url, cut, before, after).select(
        "time_period", F.col(SESSION_ID).alias("cart_session_id"),
        F.col(PAGEVIEW_ID).alias("cart_pageview_id"))


def cart_clickthroughs(pageviews: DataFrame, window: TimeRange, url: str, cut: str, before: str,
                       after: str) -> DataFrame:
    """Per (period, cart session) with any later pageview: the first later pageview id."""
    return next_pageview(pageviews, window, url, cut, before, after, keep_unmatched=False).select(
        "time_period", F.col(SESSION_ID).alias("cart_session_id"),
        F.col("next_pageview_id").alias("pv_id_after_cart"))


def cart_orders(carts: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of cart sessions, per period, as distinct rows with ``n_rows``.

    The literal table pairs each cart view with each order of its session
    (views x orders rows per session, identical for views of one period).
    Here each (period, session, order) appears once with ``n_rows`` = the
    session's cart views in that period: the same multiset, linear in orders.
    """
    views = carts.groupBy("time_period", "cart_session_id").agg(F.count(F.lit(1)).alias("n_rows"))
    o = orders.select(F.col(SESSION_ID).alias("cart_session_id"), "order_id", "items_purchased", "price_usd")
    return join_keyed(o, views, "cart_session_id", range_of=carts).select(
        "time_period", "cart_session_id", "order_id", "items_purchased", "price_usd", "n_rows")


def cross_sell(pageviews: DataFrame, orders: DataFrame, window: TimeRange, url: str, cut: str, before: str,
               after: str, dedupe: bool = False) -> DataFrame:
    """Per period before / after ``cut``: cart sessions, click-throughs, orders, products, AOV, revenue.

    Default: the numbers of joining every cart view to the session's
    click-through rows and to its (cart view x order) rows on session id
    only, then summing, which multiplies rows (a session with 2 cart views and 1
    order adds 4 to ``orders_placed``).  The multiplicities are computed as
    counts per session instead of materialised:

    * ``c_p``  cart views of the session in the period, ``c`` in all periods
    * ``a``    periods in which some cart view of the session has a later page
    * ``m``    orders of the session, so ``c * m`` (cart view, order) rows

    Each cart view then stands for ``max(1,a) * max(1,c*m)`` joined rows.

    With ``dedupe``, every cart session counts once per period, as clicked when a page
    follows a cart view of the period, with each of its orders once.
    """
    periods = {"b": before, "a": after}
    late = F.col("created_at") >= ts_literal(cut)
    viewed = window.on("created_at") & (F.col("pageview_url") == url)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # one pass over the pageviews of the cart sessions: cart views and their
    # earliest one per period, and the session's last pageview
    in_period = {"b": viewed & ~late, "a": viewed & late}
    aggs = [F.max(PAGEVIEW_ID).alias("_last")]
    for k, cond in in_period.items():
        aggs += [F.count(F.when(cond, one)).alias(f"_c{k}"), F.min(F.when(cond, F.col(PAGEVIEW_ID))).alias(f"_first_{k}")]
    views = pageviews.filter(viewed).select(SESSION_ID)
    sessions = per_key(pageviews, views, SESSION_ID, *aggs).filter(F.col("_cb") + F.col("_ca") > 0)
    per_order = per_key(orders, views, SESSION_ID, F.count("order_id").alias("_m"),
                        F.sum("items_purchased").alias("_items"), F.sum("price_usd").alias("_price"))
    clicked = {k: F.coalesce((F.col("_last") > F.col(f"_first_{k}")).cast("long"), none) for k in periods}
    rows = (sessions.join(per_order, SESSION_ID, "left").fillna(0, subset=["_m"])
            .withColumn("_c", F.col("_cb") + F.col("_ca")).withColumn("_a", clicked["b"] + clicked["a"])
            .withColumn("_p", F.explode(F.array(*[F.struct(F.lit(name).alias("time_period"), F.col(f"_c{k}").alias("cp"), clicked[k].alias("clicked"))
                                                  for k, name in periods.items()])))
            .filter(F.col("_p.cp") > 0))
    cp, c, a, m = F.col("_p.cp"), F.col("_c"), F.col("_a"), F.col("_m")
    if dedupe:
        clicks, placed, weight = F.col("_p.clicked"), m, one
    else:
        clicks = cp * a * F.greatest(one, c * m)
        placed = cp * F.greatest(one, a) * c * m
        weight = cp * F.greatest(one, a) * c
    has_order = m > 0
    return pre_post(rows, F.col("_p.time_period"), {
        "cart_sessions": F.count(F.lit(1)),
        "clickthroughs": F.sum(clicks),
        "orders_placed": F.sum(placed),
        "products_purchased": F.sum(F.when(has_order, weight * F.col("_items"))),
        "_revenue": F.sum(F.when(has_order, weight * F.col("_price"))).cast("decimal(18,2)"),
    }, ["cart_sessions", "clickthroughs", ("cart_ctr", "clickthroughs", "cart_sessions"), "orders_placed", "products_purchased",
        ("products_per_order", "products_purchased", "orders_placed"), ("aov", "_revenue", "orders_placed"),
        ("rev_per_cart_session", "_revenue", "cart_sessions")])


def portfolio_pre_post(sessions: DataFrame, orders: DataFrame, window: TimeRange, cut: str, before: str,
                       after: str) -> DataFrame:
    """Conversion, AOV, products per order and revenue per session before / after ``cut``."""
    so = session_orders(sessions, orders, window)
    return pre_post(so, period_label("created_at", cut, before, after),
                    {"_s": n_sessions(), "_o": n_orders(), "_r": F.sum("revenue"), "_i": F.sum("items")},
                    [("conv_rate", "_o", "_s"), ("average_order_value", "_r", "_o"),
                     ("products_per_order", "_i", "_o"), ("revenue_per_session", "_r", "_s")])


def monthly_refund_rate(items: DataFrame, refunds: DataFrame, window: TimeRange,
                        products: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Items sold and share refunded per product per month of the item.

    An item may be refunded in several parts: refunds are made distinct first, so
    every distinct count of items is a plain conditional count.
    """
    refunded = refunds.select("order_item_id").distinct().withColumn("_refunded", F.lit(1))
    rows = items.filter(window.on("created_at")).join(refunded, "order_item_id", "left")
    pid = F.col("product_id")
    aggs = []
    for p in products:
        aggs += [F.count(F.when(pid == p, F.lit(1))).alias(f"p{p}_orders"),
                 F.count(F.when((pid == p) & F.col("_refunded").isNotNull(), F.lit(1))).alias(f"_r{p}")]
    monthly = rows.groupBy(F.year("created_at").alias("yr"), F.month("created_at").alias("mo")).agg(*aggs)
    cols = ["yr", "mo"]
    for p in products:
        cols += [f"p{p}_orders", safe_ratio(f"_r{p}", f"p{p}_orders").alias(f"p{p}_refund_rt")]
    return monthly.select(*cols)
