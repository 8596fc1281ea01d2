"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The label the reference puts in the ELSE branch of its
# period CASE expressions (reached only by NULL timestamps).
GUARD_LABEL = "uh on...check logic"

# Referers the channel rules treat as search engines.
SEARCH_REFERERS = ("https://www.gsearch.com", "https://www.bsearch.com")


def col(c: str | Column) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def ts_literal(value: str) -> Column:
    """A TIMESTAMP_NTZ literal; a bare date means midnight."""
    text = value if " " in value else f"{value} 00:00:00"
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``a / b`` as DOUBLE, NULL when ``b`` is 0 or NULL (MySQL's rule)."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def week_mode0(ts: str | Column) -> Column:
    """MySQL ``WEEK(d)`` in its default mode 0.

    Weeks start on Sunday; days before the year's first Sunday are week 0.
    Spark's ``weekofyear`` is ISO and gives other numbers.
    """
    d = F.to_date(col(ts))
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def week_start_sunday(ts: str | Column) -> Column:
    """The Sunday starting the week of ``ts``: one value per MySQL ``YEARWEEK``."""
    d = F.to_date(col(ts))
    return F.date_sub(d, F.dayofweek(d) - 1)


def yearweek_mode0(ts: str | Column) -> Column:
    """MySQL ``YEARWEEK(d)`` (mode 0) as the number ``yyyyww``.

    The week belongs to the year of its starting Sunday's week count: a
    week 0 date belongs to the previous year's last week.
    """
    start = week_start_sunday(ts)
    return (F.year(start) * 100 + week_mode0(start)).cast("int")


def period_label(ts: str | Column, cut: str, before: str, after: str,
                 guard: str = GUARD_LABEL) -> Column:
    """``before`` when ``ts < cut``, ``after`` when ``ts >= cut``, else ``guard``."""
    t = col(ts)
    cut_ts = ts_literal(cut)
    return F.when(t < cut_ts, before).when(t >= cut_ts, after).otherwise(guard)


def flag(condition: Column) -> Column:
    """A 0/1 INT column."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_distinct_if(condition: Column, key: str | Column, unique: bool = False) -> Column:
    """``COUNT(DISTINCT CASE WHEN condition THEN key END)``.

    With ``unique=True`` the caller guarantees that ``key`` does not repeat
    inside the aggregated rows; the count is then a plain ``count``, which
    needs no Expand and no second shuffle.
    """
    value = F.when(condition, col(key))
    return F.count(value) if unique else F.countDistinct(value)


def first_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """A searched CASE without ELSE: the label of the first true rule, else NULL."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out


def channel_group(with_social: bool = False) -> Column:
    """Traffic channel of a session from its UTM fields and referer.

    The four-way rule set; ``with_social`` appends ``paid_social`` last, so
    campaign rules still win for social sessions.  Sessions matching no rule
    get NULL.
    """
    src, camp, ref = F.col("utm_source"), F.col("utm_campaign"), F.col("http_referer")
    # The channel labels and the order of the rules, as the
    # analysis defines them (first match wins).
    rules = [
        (src.isNull() & ref.isin(*SEARCH_REFERERS), "organic_search"),
        (camp == "nonbrand", "paid_nonbrand"),
        (camp == "brand", "paid_brand"),
        (src.isNull() & ref.isNull(), "direct_type_in"),
    ]
    if with_social:
        rules.append((src == "socialbook", "paid_social"))
    return first_match(rules)
