"""Seasonality: weekly volume and the hour-by-weekday heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from funnelwise.functions.columns import week_mode0
from funnelwise.functions.ranges import TimeRange
from funnelwise.operators.traffic import n_orders, n_sessions, session_orders

# MySQL WEEKDAY() numbers (Monday = 0) and the output names.
WEEKDAY_COLUMNS = {0: "mon", 1: "tue", 2: "wed", 3: "thu", 4: "fri", 5: "sat", 6: "sun"}


def weekly_seasonality(sessions: DataFrame, orders: DataFrame, window: TimeRange) -> DataFrame:
    """Sessions and orders per (YEAR, WEEK mode 0) of the session."""
    so = session_orders(sessions, orders, window)
    return (so.groupBy(F.year("created_at").alias("yr"), week_mode0("created_at").alias("wk"))
            .agg(F.min(F.to_date("created_at")).alias("week_start"),
                 n_sessions().alias("sessions"), n_orders().alias("orders")))


def hour_weekday_heatmap(sessions: DataFrame, window: TimeRange) -> DataFrame:
    """Average sessions per hour of day and weekday, 1 decimal, ordered by hour.

    The mean runs over the dates that have sessions in that hour and
    weekday: first a count per (date, weekday, hour), then a conditional
    average per hour.  Both levels aggregate map-side.
    """
    daily = (sessions.filter(window.on("created_at"))
             .groupBy(F.to_date("created_at").alias("created_date"),
                      F.weekday("created_at").alias("wkday"),
                      F.hour("created_at").alias("hr"))
             .agg(F.count(F.lit(1)).alias("website_sessions")))
    return (daily.groupBy("hr")
            .agg(*[F.round(F.avg(F.when(F.col("wkday") == d, F.col("website_sessions"))), 1).alias(name)
                   for d, name in WEEKDAY_COLUMNS.items()])
            .orderBy("hr"))
