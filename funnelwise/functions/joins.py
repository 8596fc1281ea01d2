"""Joins and aggregates over the rows of a set of keys, in one plan for every size.

* ``key_range`` bounds the big table by the smallest and largest key (scalar
  subqueries, pushed to the Parquet scan).  Ids rise with time and files are
  clustered by time, so a window of sessions reads its own part of the
  pageviews instead of all that were ever stored.
* ``per_key`` aggregates the bounded rows per key, so a key with a third of
  all rows is combined in every task before the shuffle.
* ``rekeyed`` puts a key column behind an expression.  What stands above then
  gets a shuffle of its own: a join with an aggregate has a fresh shuffle on both
  sides, and an aggregate after a join doesn't rely on the join's partitioning.
  In both cases adaptive execution can split a hot key's partition of the
  join (``spark.sql.adaptive.skewJoin.enabled``, on by default), at the price of
  one more shuffle of rows that are already combined.

Nothing here counts rows, forces a broadcast or starts a job: adaptive
execution picks broadcasts from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def key_range(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` lies between the smallest and the largest one of ``keys``
    (none when ``keys`` is empty)."""
    low, high = keys.agg(F.min(key)).scalar(), keys.agg(F.max(key)).scalar()
    return rows.filter((F.col(key) >= low) & (F.col(key) <= high))


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with an integer key column as a computed one (same values)."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def per_key(rows: DataFrame, keys: DataFrame, key: str, *aggs: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key (and ``by`` value) among the rows in the range of ``keys``.

    May hold keys between those of ``keys``; callers join it with their keys.
    """
    return key_range(rows, keys, key).groupBy(key, *by).agg(*aggs)


def aggregate_for_keys(rows: DataFrame, keys: DataFrame, key: str, *aggs: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """``per_key`` for exactly the keys of ``keys``."""
    return per_key(rows, keys, key, *aggs, by=by).join(keys.select(key).distinct(), key, "left_semi")


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, range_of: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (few rows per key); a hot key can be split.

    ``range_of``: a cheaper relation with the same keys for the range.
    """
    return key_range(rows, keyed if range_of is None else range_of, key).join(rekeyed(keyed, key), key)
