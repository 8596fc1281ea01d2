"""Time windows with the exact bound forms the analyses use.

``before(hi)``        created_at <  hi
``open_range(lo,hi)`` created_at >  lo  and created_at <  hi
``half_open(lo,hi)``  created_at >= lo  and created_at <  hi
``between(lo,hi)``    created_at >= lo  and created_at <= hi   (SQL BETWEEN;
                      a bare date end means midnight, so that day is out)
``everything()``      no bound

Predicates compare the column with TIMESTAMP_NTZ literals, so they reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from funnelwise.functions.columns import col, ts_literal


@dataclass(frozen=True)
class TimeRange:
    lo: str | None = None
    hi: str | None = None
    lo_inclusive: bool = False
    hi_inclusive: bool = False

    @property
    def unbounded(self) -> bool:
        return self.lo is None and self.hi is None

    def on(self, c: str | Column = "created_at") -> Column:
        t = col(c)
        cond = F.lit(True)
        if self.lo is not None:
            cond = cond & ((t >= ts_literal(self.lo)) if self.lo_inclusive else (t > ts_literal(self.lo)))
        if self.hi is not None:
            cond = cond & ((t <= ts_literal(self.hi)) if self.hi_inclusive else (t < ts_literal(self.hi)))
        return cond


def before(hi: str) -> TimeRange:
    """created_at < hi."""
    return TimeRange(hi=hi)


def open_range(lo: str, hi: str) -> TimeRange:
    """lo < created_at < hi."""
    return TimeRange(lo=lo, hi=hi)


def half_open(lo: str, hi: str) -> TimeRange:
    """lo <= created_at < hi."""
    return TimeRange(lo=lo, hi=hi, lo_inclusive=True)


def between(lo: str, hi: str) -> TimeRange:
    """lo <= created_at <= hi (SQL BETWEEN)."""
    return TimeRange(lo=lo, hi=hi, lo_inclusive=True, hi_inclusive=True)


def everything() -> TimeRange:
    """no bound."""
    return TimeRange()
