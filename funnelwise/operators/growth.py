"""Quarterly growth: volume, efficiency and orders per channel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.functions.ranges import TimeRange, everything
from funnelwise.operators.traffic import n_orders, n_sessions, session_orders, trend, with_ratios


def quarterly_volume(sessions: DataFrame, orders: DataFrame, window: TimeRange = everything()) -> DataFrame:
    """Sessions and orders per quarter of the session."""
    so = session_orders(sessions, orders, window)
    return trend(so, "quarter", {"sessions": n_sessions(), "orders": n_orders()}).orderBy("yr", "qtr")


def quarterly_efficiency(sessions: DataFrame, orders: DataFrame, window: TimeRange = everything()) -> DataFrame:
    """Conversion, revenue per order and revenue per session per quarter."""
    so = session_orders(sessions, orders, window)
    q = trend(so, "quarter", {"_s": n_sessions(), "_o": n_orders(), "_r": F.sum("revenue")})
    return with_ratios(q, ["yr", "qtr", ("session_to_order_conv_rate", "_o", "_s"),
                           ("revenue_per_order", "_r", "_o"), ("revenue_per_session", "_r", "_s")]
                       ).orderBy("yr", "qtr")


def quarterly_channel_orders(sessions: DataFrame, orders: DataFrame, channels: Mapping[str, Column],
                             window: TimeRange = everything()) -> DataFrame:
    """Orders per quarter for each named session condition."""
    so = session_orders(sessions, orders, window)
    return trend(so, "quarter", {name: n_orders(c) for name, c in channels.items()}).orderBy("yr", "qtr")
