"""Repeat visitors: new sessions with the same user's repeat sessions, repeat
counts, time to the second session, repeat traffic by channel and the
conversion of new versus repeat sessions.

The new-to-repeat pairing is per user.  A user can own a third of all
sessions, so nothing here groups a user's sessions into one task:

* listings are an inner equi-join (adaptive execution splits a skewed
  partition on either side) plus the new sessions without any repeat, found
  by an anti-join against the distinct repeat users;
* summaries (repeat counts, first repeat) aggregate repeat sessions per user
  first, map-side, and join the one-row-per-user result to new sessions.

Aggregated sides are joined under a computed key (``rekeyed``), so both sides of
every join of raw sessions are fresh shuffles and a hot user can be split.
New sessions are paired with all repeat sessions of their user, as many rows as
the listing has; with one new session per user it is linear in sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.columns import channel_group
from funnelwise.functions.joins import rekeyed
from funnelwise.functions.ranges import TimeRange
from funnelwise.operators.traffic import conversion

SESSION_ID = "website_session_id"


def _split(sessions: DataFrame, window: TimeRange) -> tuple[DataFrame, DataFrame]:
    s = sessions.filter(window.on("created_at"))
    return s.filter(F.col("is_repeat_session") == 0), s.filter(F.col("is_repeat_session") == 1)


def new_with_repeats(sessions: DataFrame, window: TimeRange, with_times: bool = False) -> DataFrame:
    """New sessions of the window with each repeat session of the same user in the window.

    New sessions without any repeat keep one row with NULL repeat columns.
    """
    new, repeat = _split(sessions, window)
    new_cols = [F.col("user_id"), F.col(SESSION_ID).alias("new_session_id")]
    rep_cols = [F.col("user_id"), F.col(SESSION_ID).alias("repeat_session_id")]
    if with_times:
        new_cols.append(F.col("created_at").alias("new_session_created_at"))
        rep_cols.append(F.col("created_at").alias("repeat_session_created_at"))
    n, r = new.select(*new_cols), repeat.select(*rep_cols)
    matched = n.join(r, "user_id", "inner")
    repeat_users = repeat.select("user_id").distinct()
    unmatched = n.join(rekeyed(repeat_users, "user_id"), "user_id", "left_anti")
    for c in r.columns:
        if c != "user_id":
            unmatched = unmatched.withColumn(c, F.lit(None).cast(r.schema[c].dataType))
    out_cols = ["user_id", "new_session_id"] + (["new_session_created_at"] if with_times else []) + \
        ["repeat_session_id"] + (["repeat_session_created_at"] if with_times else [])
    return matched.select(*out_cols).unionByName(unmatched.select(*out_cols))


def repeat_distribution(sessions: DataFrame, window: TimeRange) -> DataFrame:
    """Users with a new session in the window, by number of repeat sessions (0 included)."""
    new, repeat = _split(sessions, window)
    new_users = new.select("user_id").distinct()
    repeats = repeat.groupBy("user_id").agg(F.count(SESSION_ID).alias("_n"))
    per_user = (new_users.join(repeats, "user_id", "left")
                .select("user_id", F.coalesce(F.col("_n"), F.lit(0).cast("long")).alias("repeat_sessions")))
    return per_user.groupBy("repeat_sessions").agg(F.count("user_id").alias("users"))


def first_to_second(sessions: DataFrame, window: TimeRange) -> DataFrame:
    """Per new session with a repeat: days from it to the user's earliest repeat.

    MIN of repeat times per user, joined to the user's new sessions; the day
    difference uses date parts only (MySQL DATEDIFF).
    """
    new, repeat = _split(sessions, window)
    first_repeat = repeat.groupBy("user_id").agg(F.min("created_at").alias("_second_at"))
    return (new.select("user_id", F.col("created_at").alias("_new_at"))
            .join(rekeyed(first_repeat, "user_id"), "user_id", "inner")
            .select("user_id", F.datediff(F.col("_second_at"), F.col("_new_at"))
                    .alias("days_first_to_second_session")))


def time_to_repeat(days: DataFrame) -> DataFrame:
    """Average, minimum and maximum days from a new session to the first repeat."""
    d = F.col("days_first_to_second_session")
    return days.agg(F.avg(d).alias("avg_days_first_to_second"), F.min(d).alias("min_days_first_to_second"),
                    F.max(d).alias("max_days_first_to_second"))


def new_vs_repeat(rows: DataFrame, *by: str | Column) -> DataFrame:
    """New and repeat sessions per ``by``, most repeat sessions first."""
    rep = F.col("is_repeat_session")
    return (rows.groupBy(*by)
            .agg(F.count(F.when(rep == 0, F.col(SESSION_ID))).alias("new_sessions"),
                 F.count(F.when(rep == 1, F.col(SESSION_ID))).alias("repeat_sessions"))
            .orderBy(F.desc("repeat_sessions")))


def repeat_by_source(sessions: DataFrame, window: TimeRange) -> DataFrame:
    """New and repeat sessions per (utm_source, utm_campaign, http_referer)."""
    return new_vs_repeat(sessions.filter(window.on("created_at")),
                              "utm_source", "utm_campaign", "http_referer")


def repeat_by_channel(sessions: DataFrame, window: TimeRange) -> DataFrame:
    """New and repeat sessions per channel (five-way rules, NULL when none match)."""
    return new_vs_repeat(sessions.filter(window.on("created_at")),
                              channel_group(with_social=True).alias("channel_group"))


def new_vs_repeat_conversion(sessions: DataFrame, orders: DataFrame, window: TimeRange) -> DataFrame:
    """Sessions, conversion and revenue per session for new versus repeat sessions."""
    return conversion(sessions, orders, window, by=["is_repeat_session"], orders_col=None,
                      rate_col="conv_rate", revenue_per_session_col="rev_per_session")

