"""Page views, entry (landing) pages, bounces and landing / billing A/B tests.

Landing page: the page of a session's lowest pageview id.  Instead of the
"MIN id, then look the id up again" pair of joins, one aggregate keeps the
minimum of ``struct(id, url, created_at)`` per session (ids are unique, so it
is the same row).  Aggregates combine map-side, so a session with a huge
number of pageviews is reduced inside every input task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.columns import safe_ratio, week_start_sunday
from funnelwise.functions.joins import key_range, per_key
from funnelwise.functions.ranges import TimeRange, everything

SESSION_ID = "website_session_id"
PAGEVIEW_ID = "website_pageview_id"


def page_views(pageviews: DataFrame, window: TimeRange) -> DataFrame:
    """Pageviews per url, most viewed first (ids are unique: a row count)."""
    return (pageviews.filter(window.on("created_at")).groupBy("pageview_url")
            .agg(F.count(PAGEVIEW_ID).alias("pvs")).orderBy(F.desc("pvs")))


def first_pageview(pageviews: DataFrame, window: TimeRange, out_col: str) -> DataFrame:
    """Lowest pageview id per session among pageviews in the window."""
    return (pageviews.filter(window.on("created_at")).groupBy(SESSION_ID)
            .agg(F.min(PAGEVIEW_ID).alias(out_col)))


def landing_page(pageviews: DataFrame, window: TimeRange = everything(), urls: Sequence[str] | None = None,
                 min_id: Column | None = None, sessions: DataFrame | None = None, count_pages: bool = True) -> DataFrame:
    """Per session: website_session_id, landing_page, first_pageview_id, first_at, n_pages.

    The landing page is the one of the lowest pageview id inside ``window`` (and
    above ``min_id``); ``n_pages`` counts all pageviews of the session, inside the
    window or not, and isn't there without ``count_pages``, when only the window is read.  ``sessions`` keeps only those sessions; ``urls`` only
    sessions that landed on one of them.  One scan and one aggregate,
    bounded by the ids of the sessions in question.
    """
    counts = window.on("created_at")
    if min_id is not None:
        counts = counts & (F.col(PAGEVIEW_ID) > min_id)
    if not count_pages:
        pageviews = pageviews.filter(counts)
    if sessions is not None:
        bounded = key_range(pageviews, sessions, SESSION_ID)
    elif count_pages and not window.unbounded:
        bounded = key_range(pageviews, pageviews.filter(window.on("created_at")).select(SESSION_ID), SESSION_ID)
    else:
        bounded = pageviews
    first = F.min(F.when(counts, F.struct(F.col(PAGEVIEW_ID), F.col("pageview_url"), F.col("created_at"))))
    n_pages = [F.count(PAGEVIEW_ID).alias("n_pages")] if count_pages else []
    out = (bounded.groupBy(SESSION_ID).agg(first.alias("_f"), *n_pages)
           .filter(F.col("_f").isNotNull())
           .select(SESSION_ID, F.col("_f.pageview_url").alias("landing_page"),
                   F.col("_f.website_pageview_id").alias("first_pageview_id"),
                   F.col("_f.created_at").alias("first_at"), *(["n_pages"] if count_pages else [])))
    if sessions is not None:
        out = out.join(sessions.select(SESSION_ID), SESSION_ID, "left_semi")
    return out if urls is None else out.filter(F.col("landing_page").isin(*urls))


def entry_page_counts(pageviews: DataFrame, window: TimeRange) -> DataFrame:
    """Sessions per landing page (``Landing_page``, ``sessions_hitting_page``)."""
    first = F.min(F.struct(F.col(PAGEVIEW_ID), F.col("pageview_url")))
    entries = pageviews.filter(window.on("created_at")).groupBy(SESSION_ID).agg(first.alias("_f"))
    return (entries.groupBy(F.col("_f.pageview_url").alias("Landing_page"))
            .agg(F.count(SESSION_ID).alias("sessions_hitting_page")))


def bounced_sessions(landing: DataFrame) -> DataFrame:
    """Landing sessions (of ``landing_page``) with exactly one pageview."""
    return landing.filter(F.col("n_pages") == 1).select(
        SESSION_ID, "landing_page", F.col("n_pages").alias("count_of_pages_viewed"))


def bounce_detail(landing: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each landing session with its id again when it bounced, else NULL."""
    bounced = F.when(F.col("n_pages") == 1, F.col(SESSION_ID))
    return (landing.select(*keep, SESSION_ID, bounced.alias("bounced_website_session_id"))
            .orderBy(SESSION_ID))


def bounce_rate(landing: DataFrame, total_col: str = "total_sessions") -> DataFrame:
    """Sessions, bounced sessions and their ratio."""
    return landing.agg(
        F.count(SESSION_ID).alias(total_col),
        F.count(F.when(F.col("n_pages") == 1, F.lit(1))).alias("bounced_sessions"),
    ).withColumn("bounce_rate", safe_ratio("bounced_sessions", total_col))


def after_first_seen(pageviews: DataFrame, url: str, strict: bool = True) -> Column:
    """Condition on pageviews: id above (or from, unless ``strict``) the first view of ``url``.

    The first id is a scalar subquery: its own small job, no join.
    """
    first = first_pageview_id(pageviews, url)
    return F.col(PAGEVIEW_ID) > first if strict else F.col(PAGEVIEW_ID) >= first


def ab_test(exposures: DataFrame, variant: str, outcome: Column, names: Sequence[str] = ("sessions", "outcomes", "rate")) -> DataFrame:
    """Sessions, outcomes and rate per variant.

    ``exposures`` has one row per session and variant seen; ``outcome`` is its
    number of outcomes (a 0/1 flag or a count).
    """
    sessions, outcomes, rate = names
    return (exposures.groupBy(variant)
            .agg(F.count(SESSION_ID).alias(sessions), F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias(outcomes))
            .withColumn(rate, safe_ratio(outcomes, sessions)))


def first_seen(pageviews: DataFrame, url: str) -> DataFrame:
    """When a page was first seen: earliest time and lowest id (taken separately)."""
    return (pageviews.filter((F.col("pageview_url") == url) & F.col("created_at").isNotNull())
            .agg(F.min("created_at").alias("first_created_at"), F.min(PAGEVIEW_ID).alias("first_pageview_id")))


def first_pageview_id(pageviews: DataFrame, url: str) -> Column:
    """Scalar subquery: the lowest pageview id of ``url``.

    Spark runs it once as its own small job and inlines the value as a
    literal in the outer filter (no join, no broadcast of data).
    """
    return pageviews.filter(F.col("pageview_url") == url).agg(F.min(PAGEVIEW_ID)).scalar()


def session_first_page_and_count(sessions: DataFrame, pageviews: DataFrame, window: TimeRange,
                                 where: Column) -> DataFrame:
    """Sessions of a segment with first pageview (id, url, time) and pageview count.

    Sessions without pageviews keep NULL first page and a count of 0.
    """
    s = sessions.filter(window.on("created_at") & where).select(SESSION_ID)
    first = F.min(F.struct(F.col(PAGEVIEW_ID), F.col("pageview_url"), F.col("created_at")))
    agg = per_key(pageviews, s, SESSION_ID, first.alias("_f"), F.count(PAGEVIEW_ID).alias("count_pageviews"))
    return (s.join(agg, SESSION_ID, "left").fillna(0, subset=["count_pageviews"])
            .select(SESSION_ID,
                    F.col("_f.website_pageview_id").alias("first_pageview_id"),
                    "count_pageviews",
                    F.col("_f.pageview_url").alias("landing_page"),
                    F.col("_f.created_at").alias("session_created_at")))


def weekly_bounce_and_lander(detail: DataFrame, home: str = "/home", lander: str = "/lander-1") -> DataFrame:
    """Bounce rate and sessions per landing page for each Sunday week of the first pageview.

    Sessions without pageviews have no first-page time and form a NULL week.
    """
    sid, lp = F.col(SESSION_ID), F.col("landing_page")
    return (detail.groupBy(week_start_sunday("session_created_at").alias("_week"))
            .agg(F.min(F.to_date("session_created_at")).alias("week_start_date"),
                 F.count(F.when(F.col("count_pageviews") == 1, sid)).alias("_bounced"),
                 F.count(sid).alias("_sessions"),
                 F.count(F.when(lp == home, sid)).alias("home_sessions"),
                 F.count(F.when(lp == lander, sid)).alias("lander_sessions"))
            .select("week_start_date", safe_ratio("_bounced", "_sessions").alias("bounce_rate"),
                    "home_sessions", "lander_sessions"))


def page_views_of_test(pageviews: DataFrame, started: Column, window: TimeRange, urls: Sequence[str]) -> DataFrame:
    """Views of the tested ``urls`` once the test has ``started``: session, version seen."""
    return (pageviews.filter(window.on("created_at") & F.col("pageview_url").isin(*urls) & started)
            .select(SESSION_ID, F.col("pageview_url").alias("billing_version_seen")))


def billing_sessions(views: DataFrame, orders: DataFrame) -> DataFrame:
    """Billing views of the test with the session's orders.

    The literal listing pairs each billing view with each order of its
    session (NULL order when none), repeating a row per view of one version.
    Here each (session, version, order) appears once with ``n_rows`` = the
    session's views of that version: the same multiset, linear in views.
    """
    seen = views.groupBy(SESSION_ID, "billing_version_seen").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = key_range(orders, views, SESSION_ID).select(SESSION_ID, "order_id")
    return seen.join(placed, SESSION_ID, "left").select(SESSION_ID, "billing_version_seen", "order_id", "n_rows")


def billing_conversion(views: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions, orders and order rate per billing page version.

    A session that saw both versions counts in both.  Views are first
    reduced to distinct (session, version) pairs and orders to counts per
    session, so both counts are plain sums over unique rows.
    """
    per = per_key(orders, views, SESSION_ID, F.count("order_id").alias("n_orders"))
    return ab_test(views.distinct().join(per, SESSION_ID, "left"), "billing_version_seen", F.col("n_orders"),
                   ("sessions", "orders", "billing_to_order_rt"))
