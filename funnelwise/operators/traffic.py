"""Traffic sources, conversion and trends over sessions (and their orders).

Distinct counts: ``website_sessions`` has one row per session and
``web_orders`` one row per order, so once orders are folded to one row per
session and joined 1:1 to sessions, every
``COUNT(DISTINCT session)`` is a row count and every ``COUNT(DISTINCT
order)`` a sum of per-session order counts.  The aggregates therefore run
with map-side partial aggregation and need no Expand and no second shuffle,
which multi-column distinct counts would cost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.columns import count_distinct_if, safe_ratio, week_mode0, week_start_sunday
from funnelwise.functions.joins import key_range
from funnelwise.functions.ranges import TimeRange, everything

SESSION_ID = "website_session_id"


def sessions_in(sessions: DataFrame, window: TimeRange = everything(), where: Column | None = None) -> DataFrame:
    """Sessions started in ``window`` that satisfy ``where``."""
    out = sessions.filter(window.on("created_at"))
    return out.filter(where) if where is not None else out


def order_measures(products: Sequence[int] = ()) -> list[Column]:
    """Per-session order aggregates: count, revenue, items, counts per product."""
    aggs = [
        F.count("order_id").alias("n_orders"),
        F.sum("price_usd").alias("revenue"),
        F.sum("items_purchased").alias("items"),
    ]
    return aggs + [F.count(F.when(F.col("primary_product_id") == p, F.col("order_id"))).alias(f"n_orders_p{p}")
                   for p in products]


def session_orders(sessions: DataFrame, orders: DataFrame, window: TimeRange = everything(),
                   where: Column | None = None, products: Sequence[int] = ()) -> DataFrame:
    """Sessions in the window, each with its folded orders (0 / NULL when none).

    Equal to ``sessions LEFT JOIN orders`` for every aggregate below: counts
    of orders become sums of ``n_orders``; ``revenue`` and ``items`` stay
    NULL for sessions without orders, as SUM over the outer join's NULLs.
    """
    s = sessions_in(sessions, window, where)
    # Orders are folded per session first (map-side combine), those in the
    # range of the window's session ids.
    bounded = orders if window.unbounded else key_range(orders, s, SESSION_ID)
    per = bounded.groupBy(SESSION_ID).agg(*order_measures(products))
    zero_cols = ["n_orders"] + [f"n_orders_p{p}" for p in products]
    return s.join(per, SESSION_ID, "left").fillna(0, subset=zero_cols)


def n_sessions() -> Column:
    """Sessions in the group (rows hold one session each)."""
    return F.count(F.lit(1))


def n_orders(condition: Column | None = None) -> Column:
    """Orders of the group's sessions (optionally of those meeting ``condition``); 0 when none."""
    value = F.col("n_orders") if condition is None else F.when(condition, F.col("n_orders"))
    return F.coalesce(F.sum(value), F.lit(0).cast("long"))


def source_breakdown(sessions: DataFrame, window: TimeRange,
                     dims: Sequence[str] = ("utm_source", "utm_campaign", "http_referer")) -> DataFrame:
    """Sessions per combination of ``dims`` (NULLs form their own groups), largest first."""
    return (sessions_in(sessions, window).groupBy(*dims)
            .agg(n_sessions().alias("sessions"))
            .orderBy(F.desc("sessions")))


def conversion(sessions: DataFrame, orders: DataFrame, window: TimeRange, where: Column | None = None,
               by: Sequence[str | Column] = (), sessions_col: str | None = "sessions",
               orders_col: str | None = "orders", rate_col: str = "conv_rate",
               revenue_per_session_col: str | None = None,
               revenue_per_order_col: str | None = None) -> DataFrame:
    """Sessions, orders and session-to-order rate, optionally per ``by``."""
    so = session_orders(sessions, orders, window, where)
    aggs = [n_sessions().alias("_s"), n_orders().alias("_o"), F.sum("revenue").alias("_r")]
    grouped = so.groupBy(*by).agg(*aggs) if by else so.agg(*aggs)
    out = [c for c in by]
    if sessions_col:
        out.append(F.col("_s").alias(sessions_col))
    if orders_col:
        out.append(F.col("_o").alias(orders_col))
    out.append(safe_ratio("_o", "_s").alias(rate_col))
    if revenue_per_order_col:
        out.append(safe_ratio("_r", "_o").alias(revenue_per_order_col))
    if revenue_per_session_col:
        out.append(safe_ratio("_r", "_s").alias(revenue_per_session_col))
    return grouped.select(*[F.col(c) if isinstance(c, str) else c for c in out])


def year_week_trend(rows: DataFrame, measures: Mapping[str, Column], label: str,
                    ts: str = "created_at") -> DataFrame:
    """Group by MySQL ``YEAR(ts), WEEK(ts)`` (Sunday weeks, split at New Year).

    The week label is the first date that has rows, as in
    ``MIN(DATE(created_at))``; the year and week keys are not output.
    """
    return (rows.groupBy(F.year(ts).alias("_yr"), week_mode0(ts).alias("_wk"))
            .agg(F.min(F.to_date(ts)).alias(label), *[m.alias(n) for n, m in measures.items()])
            .drop("_yr", "_wk"))


def yearweek_trend(rows: DataFrame, measures: Mapping[str, Column], label: str = "week_start_date",
                   ts: str = "created_at") -> DataFrame:
    """Group by MySQL ``YEARWEEK(ts)``: whole Sunday-to-Saturday weeks."""
    return (rows.groupBy(week_start_sunday(ts).alias("_week"))
            .agg(F.min(F.to_date(ts)).alias(label), *[m.alias(n) for n, m in measures.items()])
            .drop("_week"))


def count_if(condition: Column) -> Column:
    """Rows satisfying ``condition``; on one row per session this equals
    ``COUNT(DISTINCT CASE WHEN condition THEN website_session_id END)``."""
    return F.count(F.when(condition, F.lit(1)))


GRAINS = ("year_week", "yearweek", "month", "quarter")


def trend(rows: DataFrame, grain: str, measures: Mapping[str, Column], label: str = "week_start_date",
          ts: str = "created_at") -> DataFrame:
    """Measures per time bucket of ``ts``.

    ``year_week``: MySQL ``GROUP BY YEAR(ts), WEEK(ts)`` (Sunday weeks split
    at New Year), labelled by the first date with rows; ``yearweek``: MySQL
    ``YEARWEEK(ts)`` (whole Sunday weeks), same label; ``month`` and
    ``quarter`` output ``yr`` with ``mo`` / ``qtr``.
    """
    if grain == "year_week":
        return year_week_trend(rows, measures, label, ts)
    if grain == "yearweek":
        return yearweek_trend(rows, measures, label, ts)
    if grain == "month":
        keys = [F.year(ts).alias("yr"), F.month(ts).alias("mo")]
    elif grain == "quarter":
        keys = [F.year(ts).alias("yr"), F.quarter(ts).alias("qtr")]
    else:
        raise ValueError(f"grain must be one of {GRAINS}")
    return rows.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def conditional_counts(conditions: Mapping[str, Column], key: str = SESSION_ID,
                       unique: bool = False) -> dict[str, Column]:
    """Pivot by conditional aggregation: ``COUNT(DISTINCT CASE WHEN c THEN key END)`` per condition.

    With ``unique=True`` the caller guarantees that rows hold each key once (as
    checked session tables do), and each becomes a plain conditional count.  Where keys
    repeat, ``operators.distinct`` counts them without Spark's copy of every row per count.
    """
    return {name: count_distinct_if(cond, key, unique) for name, cond in conditions.items()}


def with_ratios(df: DataFrame, columns: Sequence[str | tuple[str, str, str]]) -> DataFrame:
    """Select ``columns``; a triple ``(name, numerator, denominator)`` is a safe ratio."""
    out = [c if isinstance(c, str) else safe_ratio(c[1], c[2]).alias(c[0]) for c in columns]
    return df.select(*out)


def pre_post(rows: DataFrame, period: Column, measures: Mapping[str, Column],
             columns: Sequence[str | tuple[str, str, str]]) -> DataFrame:
    """Measures per period (``time_period``), then ``columns`` with their ratios.

    ``period`` labels each row (see ``functions.period_label``); ``columns`` names
    measures to keep and ``(name, numerator, denominator)`` ratios.
    """
    grouped = rows.groupBy(period.alias("time_period")).agg(*[m.alias(n) for n, m in measures.items()])
    return with_ratios(grouped, ["time_period", *columns])


def weekly_sessions(sessions: DataFrame, window: TimeRange, where: Column | None,
                    label: str = "week_started_at") -> DataFrame:
    """Sessions per (YEAR, WEEK mode 0) week, labelled by the first date with sessions."""
    return trend(sessions_in(sessions, window, where), "year_week", {"sessions": n_sessions()}, label)


def weekly_device_sessions(sessions: DataFrame, window: TimeRange, where: Column | None) -> DataFrame:
    """Desktop and mobile sessions per (YEAR, WEEK mode 0) week."""
    device = F.col("device_type")
    return trend(sessions_in(sessions, window, where), "year_week", conditional_counts(
        {"desktop_sessions": device == "desktop", "mobile_sessions": device == "mobile"}, unique=True))


def weekly_channel_sessions(sessions: DataFrame, window: TimeRange, where: Column | None,
                            sources: Sequence[str] = ("gsearch", "bsearch")) -> DataFrame:
    """Sessions per source per Sunday week (YEARWEEK)."""
    src = F.col("utm_source")
    return trend(sessions_in(sessions, window, where), "yearweek",
                 conditional_counts({f"{s}_sessions": src == s for s in sources}, unique=True))


def channel_mobile_share(sessions: DataFrame, window: TimeRange, where: Column | None) -> DataFrame:
    """Sessions, mobile sessions and mobile share per source."""
    counts = (sessions_in(sessions, window, where).groupBy("utm_source")
              .agg(n_sessions().alias("sessions"), count_if(F.col("device_type") == "mobile").alias("mobile_sessions")))
    return with_ratios(counts, ["utm_source", "sessions", "mobile_sessions",
                                ("pct_mobile", "mobile_sessions", "sessions")])


def weekly_source_device_mix(sessions: DataFrame, window: TimeRange, where: Column | None) -> DataFrame:
    """Per Sunday week: desktop and mobile sessions of two sources and their ratio."""
    src, dev = F.col("utm_source"), F.col("device_type")
    weekly = trend(sessions_in(sessions, window, where), "yearweek", conditional_counts({
        "g_dtop_sessions": (src == "gsearch") & (dev == "desktop"),
        "b_dtop_sessions": (src == "bsearch") & (dev == "desktop"),
        "g_mob_sessions": (src == "gsearch") & (dev == "mobile"),
        "b_mob_sessions": (src == "bsearch") & (dev == "mobile"),
    }, unique=True))
    return with_ratios(weekly, [
        "week_start_date", "g_dtop_sessions", "b_dtop_sessions",
        ("b_pct_of_g_dtop", "b_dtop_sessions", "g_dtop_sessions"),
        "g_mob_sessions", "b_mob_sessions", ("b_pct_of_g_mob", "b_mob_sessions", "g_mob_sessions")])


def monthly_channel_mix(sessions: DataFrame, window: TimeRange, channel: Column) -> DataFrame:
    """Sessions per channel per month, with brand / direct / organic relative to paid nonbrand."""
    ch = F.col("channel_group")
    monthly = trend(sessions_in(sessions, window).withColumn("channel_group", channel), "month",
                    conditional_counts({"nonbrand": ch == "paid_nonbrand", "brand": ch == "paid_brand",
                                        "direct": ch == "direct_type_in", "organic": ch == "organic_search"}, unique=True))
    return with_ratios(monthly, [
        "yr", "mo", "nonbrand", "brand", ("brand_pct_of_nonbrand", "brand", "nonbrand"),
        "direct", ("direct_pct_of_nonbrand", "direct", "nonbrand"),
        "organic", ("organic_pct_of_nonbrand", "organic", "nonbrand")])
