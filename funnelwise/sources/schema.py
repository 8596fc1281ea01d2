"""Schemas of the five web-shop tables and light key checks.

The analyses assume the keys below are unique; several operators rely on it
to replace distinct counts with plain sums (see ``operators.traffic``).
``check_keys`` verifies them with one aggregate per table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from funnelwise.sources.snapshots import fingerprint, snapshot

TS = T.TimestampNTZType()
MONEY = T.DecimalType(8, 2)

WEBSITE_SESSIONS = T.StructType([
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("created_at", TS, False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("is_repeat_session", T.IntegerType(), False),
    T.StructField("utm_source", T.StringType(), True),
    T.StructField("utm_campaign", T.StringType(), True),
    T.StructField("device_type", T.StringType(), False),
    T.StructField("http_referer", T.StringType(), True),
])

WEBSITE_PAGEVIEWS = T.StructType([
    T.StructField("website_pageview_id", T.LongType(), False),
    T.StructField("created_at", TS, False),
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("pageview_url", T.StringType(), False),
])

WEB_ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("created_at", TS, False),
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("primary_product_id", T.IntegerType(), False),
    T.StructField("items_purchased", T.IntegerType(), False),
    T.StructField("price_usd", MONEY, False),
    T.StructField("cogs_usd", MONEY, False),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("created_at", TS, False),
    T.StructField("product_id", T.IntegerType(), False),
])

ORDER_ITEM_REFUNDS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
])

SCHEMAS = {
    "website_sessions": WEBSITE_SESSIONS,
    "website_pageviews": WEBSITE_PAGEVIEWS,
    "web_orders": WEB_ORDERS,
    "order_items": ORDER_ITEMS,
    "order_item_refunds": ORDER_ITEM_REFUNDS,
}

PRIMARY_KEYS = {
    "website_sessions": "website_session_id",
    "website_pageviews": "website_pageview_id",
    "web_orders": "order_id",
    "order_items": "order_item_id",
}


@dataclass(frozen=True)
class ShopTables:
    """The five tables every analysis reads.

    ``scratch``: a folder (inside the shared checkpoint folder) where shared
    intermediate results, the analysis' temporary tables, are kept as snapshots
    (see ``sources.snapshots``) and read by every statement that uses them;
    ``None`` builds them inside each statement's own plan.
    """

    sessions: DataFrame
    pageviews: DataFrame
    orders: DataFrame
    order_items: DataFrame
    refunds: DataFrame
    scratch: str | None = None
    _copies: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)
    _inputs: list[str] = field(default_factory=list, init=False, repr=False, compare=False)

    def temporary_table(self, name: str, parameters: Sequence[object], build: Callable[[], DataFrame]) -> DataFrame:
        """``build()``, as a snapshot in ``scratch`` if there is one; looked up once per tables object."""
        if self.scratch is None:
            return build()
        if name not in self._copies:
            if not self._inputs:
                self._inputs.append(fingerprint(self.as_dict()) or uuid.uuid4().hex)
            self._copies[name] = snapshot(self.sessions.sparkSession, self.scratch, name, parameters, self._inputs[0], build)
        return self._copies[name]

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "website_sessions": self.sessions,
            "website_pageviews": self.pageviews,
            "web_orders": self.orders,
            "order_items": self.order_items,
            "order_item_refunds": self.refunds,
        }

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` under their reference names."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)


def wall_clock(c: Column, zone: str) -> Column:
    """The date and time of a TIMESTAMP (an instant) in ``zone``, whatever the session's zone."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def conform(df: DataFrame, schema: T.StructType, source_zone: str = "UTC", collation: str | None = None) -> DataFrame:
    """Select and cast the schema's columns in order (extra columns dropped).

    Instants (TIMESTAMP columns) become wall-clock times in ``source_zone``.  With a
    ``collation`` (``UTF8_LCASE`` is what a case-insensitive MySQL column does) text columns compare, group,
    join and match IN lists under it; by default they compare byte by byte.
    """
    kinds = dict(df.dtypes)

    def one(f: T.StructField) -> Column:
        if f.dataType == T.TimestampNTZType() and kinds.get(f.name) == "timestamp":
            return wall_clock(F.col(f.name), source_zone)
        out = F.col(f.name).cast(f.dataType)
        return F.collate(out, collation) if collation and f.dataType == T.StringType() else out

    return df.select([one(f).alias(f.name) for f in schema.fields])


def collated(tables: ShopTables, collation: str) -> ShopTables:
    """The tables with text columns under ``collation``."""
    frames = [conform(df, SCHEMAS[name], collation=collation) for name, df in tables.as_dict().items()]
    return ShopTables(*frames, scratch=None)


def check_keys(tables: ShopTables) -> dict[str, int]:
    """Number of duplicated primary-key values per table (all 0 when valid).

    One partial-then-final aggregate per table; nothing but the counts
    reaches the driver.
    """
    out = {}
    frames = tables.as_dict()
    for name, key in PRIMARY_KEYS.items():
        df = frames[name]
        dup = df.groupBy(key).count().filter(F.col("count") > 1).count()
        out[name] = dup
    return out
