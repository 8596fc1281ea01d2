"""Column helpers: MySQL week rules (T1), safe division (T2), labels (T16), channels (T8)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelwise.functions.columns import (GUARD_LABEL, channel_group, period_label, safe_ratio, week_mode0,
                                          week_start_sunday, yearweek_mode0)

# Golden values (date, WEEK mode 0, YEARWEEK mode 0, ISO week, WEEKDAY) from FIXTURES.md §4.
WEEKS = [
    ("2011-12-31", 52, 201152, 52, 5),
    ("2012-01-01", 1, 201201, 52, 6),
    ("2012-12-30", 53, 201253, 52, 6),
    ("2012-12-31", 53, 201253, 1, 0),
    ("2013-01-01", 0, 201253, 1, 1),
    ("2013-01-06", 1, 201301, 1, 6),
    ("2014-01-01", 0, 201352, 1, 2),
    ("2015-01-03", 0, 201452, 1, 5),
]


def test_week_rules_match_mysql_mode0(spark):
    df = spark.createDataFrame([(d,) for d, *_ in WEEKS], "d string").select(
        "d", F.to_timestamp_ntz("d").alias("ts"))
    out = df.select("d", week_mode0("ts").alias("wk"), yearweek_mode0("ts").alias("yw"),
                    F.weekofyear("ts").alias("iso"), F.weekday("ts").alias("wd"),
                    week_start_sunday("ts").alias("sunday")).collect()
    got = {r.d: (r.wk, r.yw, r.iso, r.wd) for r in out}
    for d, wk, yw, iso, wd in WEEKS:
        assert got[d] == (wk, yw, iso, wd), d
    for r in out:
        assert r.sunday.weekday() == 6 and 0 <= (dt.date.fromisoformat(r.d) - r.sunday).days < 7


def test_week_mode0_against_python_percent_u(spark):
    days = [dt.date(2011, 12, 1) + dt.timedelta(days=i) for i in range(1600)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = dict((r.d, r.wk) for r in df.select("d", week_mode0("d").alias("wk")).collect())
    assert all(got[d] == int(d.strftime("%U")) for d in days)


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (3, 4), (None, 2), (2, None)], "a long, b long")
    assert [r.r for r in df.select(safe_ratio("a", "b").alias("r")).collect()] == [None, 0.75, None, None]


def test_period_label_guard_and_bounds(spark):
    df = spark.createDataFrame([("2013-01-05 23:59:59",), ("2013-01-06 00:00:00",), (None,)], "t string")
    out = df.select(period_label(F.to_timestamp_ntz("t"), "2013-01-06", "A", "B").alias("p")).collect()
    assert [r.p for r in out] == ["A", "B", GUARD_LABEL]


@pytest.mark.parametrize("src,camp,ref,four,five", [
    (None, None, "https://www.gsearch.com", "organic_search", "organic_search"),
    ("socialbook", "nonbrand", "https://www.socialbook.com", "paid_nonbrand", "paid_nonbrand"),
    ("socialbook", "pilot", "https://www.socialbook.com", None, "paid_social"),
    ("gsearch", "brand", "https://www.gsearch.com", "paid_brand", "paid_brand"),
    (None, None, None, "direct_type_in", "direct_type_in"),
    (None, None, "https://www.other.example", None, None),
])
def test_channel_rules_first_match_wins(spark, src, camp, ref, four, five):
    df = spark.createDataFrame([(src, camp, ref)], "utm_source string, utm_campaign string, http_referer string")
    r = df.select(channel_group(False).alias("a"), channel_group(True).alias("b")).first()
    assert (r.a, r.b) == (four, five)


def test_conditional_counts_distinct_and_unique(spark):
    from funnelwise.operators.traffic import conditional_counts
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "website_session_id long, x string")
    c = {"n_a": F.col("x") == "a", "n_b": F.col("x") == "b"}
    exact = df.agg(*[v.alias(k) for k, v in conditional_counts(c, unique=False).items()]).first()
    plain = df.dropDuplicates().agg(*[v.alias(k) for k, v in conditional_counts(c).items()]).first()
    assert (exact.n_a, exact.n_b) == (2, 1) == (plain.n_a, plain.n_b)
