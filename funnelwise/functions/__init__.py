"""Column helpers, time windows and skew-safe sequence helpers."""

from funnelwise.functions.columns import (
    GUARD_LABEL,
    channel_group,
    count_distinct_if,
    first_match,
    flag,
    period_label,
    safe_ratio,
    ts_literal,
    week_mode0,
    week_start_sunday,
    yearweek_mode0,
)
from funnelwise.functions.ranges import TimeRange, before, between, everything, half_open, open_range
from funnelwise.functions.joins import aggregate_for_keys, join_keyed, key_range, per_key, rekeyed
from funnelwise.functions.sequence import chunked_row_number

__all__ = [
    "GUARD_LABEL", "TimeRange", "aggregate_for_keys", "before", "between", "channel_group", "chunked_row_number",
    "count_distinct_if", "everything", "first_match", "flag",
    "half_open", "join_keyed", "key_range", "open_range", "per_key", "period_label", "rekeyed", "safe_ratio", "ts_literal", "week_mode0",
    "week_start_sunday", "yearweek_mode0",
]
