"""Distinct counts over rows that repeat their key: exact, without Expand, mergeable.

``COUNT(DISTINCT key)`` and several ``COUNT(DISTINCT CASE WHEN c THEN key END)`` in one
aggregate make Spark copy every row once per count (Expand).  Two ways around it:

* ``distinct_counts``: one row per (group, key) first, with a flag per condition, then
  sums of flags.  For keys of any kind, counted once.
* Bitmaps, for whole-number keys that are handed out one after another, as the shop's ids are.
  ``daily_bitmaps`` keeps, per day, group and bucket of 32,768 ids, one bitmap per measure.
  The table is stored and merged: ``roll_up`` ORs the days' bitmaps of a week, month or
  quarter and counts their bits, so a longer period needs no second look at the
  rows, and a rerun of one day replaces that day's bitmaps only.  A key that comes up
  again (re-delivered rows, several pageviews of a session, a session that goes past
  midnight) sets a bit that is set.  A bitmap has 4 KB, so keys spread thinly over
  all of BIGINT belong to ``distinct_counts``.

A hot group is combined in every task before the shuffle in both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

DAY, BUCKET = "day", "bucket"


def distinct_counts(rows: DataFrame, key: str, measures: Mapping[str, Column | None], by: Sequence[str | Column] = ()) -> DataFrame:
    """Per group ``by``: of each measure the number of distinct non-null keys among the rows
    that meet its condition (None: all rows)."""
    flags = [F.max(F.coalesce((F.lit(True) if c is None else c).cast("int"), F.lit(0))).alias(f"_m{i}") for i, c in enumerate(measures.values())]
    named = [F.col(b) if isinstance(b, str) else b for b in by]
    each = rows.groupBy(*[b.alias(f"_b{i}") for i, b in enumerate(named)], F.col(key).alias("_key")).agg(*flags)
    known = F.col("_key").isNotNull()
    sums = [F.coalesce(F.sum(F.when(known, F.col(f"_m{i}"))), F.lit(0)).cast("long").alias(n) for i, n in enumerate(measures)]
    groups = rows.select(*named).columns
    grouped = each.groupBy(*[F.col(f"_b{i}").alias(g) for i, g in enumerate(groups)]) if groups else each
    return grouped.agg(*sums)


def daily_bitmaps(rows: DataFrame, key: str, measures: Mapping[str, Column | None], by: Sequence[str] = (), ts: str = "created_at") -> DataFrame:
    """day, ``by``, bucket and one bitmap per measure: which keys of the bucket had a row that meets its condition."""
    at = F.bitmap_bit_position(F.col(key))
    bitmaps = [F.bitmap_construct_agg(at if c is None else F.when(c, at)).alias(n) for n, c in measures.items()]
    return (rows.filter(F.col(key).isNotNull())
            .groupBy(F.to_date(ts).alias(DAY), *by, F.bitmap_bucket_number(F.col(key)).alias(BUCKET)).agg(*bitmaps))


def roll_up(bitmaps: DataFrame, measures: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Distinct keys of each measure per group ``by`` (columns of the bitmap table, or expressions over its day)."""
    named = [F.col(b) if isinstance(b, str) else b for b in by]
    groups = bitmaps.select(*named).columns
    merged = bitmaps.groupBy(*named, F.col(BUCKET).alias("_bucket")).agg(*[F.bitmap_or_agg(F.col(m)).alias(m) for m in measures])
    counts = [F.coalesce(F.sum(F.bitmap_count(F.col(m))), F.lit(0)).cast("long").alias(m) for m in measures]
    return merged.groupBy(*groups).agg(*counts) if groups else merged.agg(*counts)


def grain_keys(grain: str) -> list[Column]:
    """Group keys of a bitmap table's day: ``week`` (Sunday weeks, by their first day), ``month`` or ``quarter``."""
    day = F.col(DAY)
    if grain == "week":
        return [F.date_sub(F.next_day(day, "Sunday"), 7).alias("week_start_date")]
    if grain == "month":
        return [F.year(day).alias("yr"), F.month(day).alias("mo")]
    if grain == "quarter":
        return [F.year(day).alias("yr"), F.quarter(day).alias("qtr")]
    raise ValueError("grain must be week, month or quarter")
