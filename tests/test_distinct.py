"""Distinct counts over repeated keys: equal to count(DISTINCT), no Expand, mergeable by period."""

import pytest
from pyspark.sql import functions as F

from funnelwise.operators import distinct, traffic
from tests.shopgen import multiset, random_shop, to_duckdb, to_spark
from tests.test_plans import physical

MEASURES = {"sessions": "true", "mobile": "device_type = 'mobile'", "paid": "utm_campaign = 'nonbrand'"}


@pytest.fixture(scope="module")
def redelivered(spark):
    """Sessions of which every row came twice, and the early ones four times."""
    frames = random_shop(5, 300)
    s = to_spark(spark, frames).sessions
    return s.unionAll(s).unionAll(s.filter("website_session_id < 200")).unionAll(s.filter("website_session_id < 200")).repartition(6), to_duckdb(frames)


def conditions():
    return {n: None if c == "true" else F.expr(c) for n, c in MEASURES.items()}


@pytest.mark.parametrize("grain,keys", [("week", "date_trunc('day', created_at)::DATE - date_part('dow', created_at)::INTEGER AS week_start_date"),
                                        ("month", "year(created_at)::INTEGER AS yr, month(created_at)::INTEGER AS mo"),
                                        ("quarter", "year(created_at)::INTEGER AS yr, quarter(created_at)::INTEGER AS qtr")])
@pytest.mark.parametrize("key", ["website_session_id", "user_id"])
def test_bitmaps_roll_up_to_count_distinct(redelivered, grain, keys, key):
    sessions, con = redelivered
    daily = distinct.daily_bitmaps(sessions, key, conditions())
    got = distinct.roll_up(daily, list(MEASURES), distinct.grain_keys(grain))
    counts = ", ".join(f"count(DISTINCT {key}) FILTER (WHERE {c}) AS {n}" for n, c in MEASURES.items())
    cur = con.execute(f"SELECT {keys}, {counts} FROM website_sessions GROUP BY ALL")
    cols = [d[0] for d in cur.description]
    assert multiset(got.columns, [tuple(r) for r in got.collect()]) == multiset(cols, cur.fetchall())


def test_bitmaps_of_days_merge_to_those_of_all(redelivered):
    sessions, _ = redelivered
    early, late = sessions.filter("created_at < '2013-05-05'"), sessions.filter("created_at >= '2013-05-05'")
    parts = distinct.daily_bitmaps(early, "user_id", conditions(), by=["device_type"]).unionByName(distinct.daily_bitmaps(late, "user_id", conditions(), by=["device_type"]))
    whole = distinct.daily_bitmaps(sessions, "user_id", conditions(), by=["device_type"])
    a, b = (sorted(map(tuple, distinct.roll_up(x, list(MEASURES), ["device_type"]).collect())) for x in (parts, whole))
    assert a == b
    assert distinct.roll_up(whole, ["sessions"]).first().sessions == sessions.select("user_id").distinct().count()


def test_distinct_counts_of_any_key(redelivered):
    sessions, con = redelivered
    got = distinct.distinct_counts(sessions, "http_referer", conditions(), ["utm_source"])
    counts = ", ".join(f"count(DISTINCT http_referer) FILTER (WHERE {c}) AS {n}" for n, c in MEASURES.items())
    cur = con.execute(f"SELECT utm_source, {counts} FROM website_sessions GROUP BY ALL")
    assert multiset(got.columns, [tuple(r) for r in got.collect()]) == multiset([d[0] for d in cur.description], cur.fetchall())
    one = distinct.distinct_counts(sessions, "user_id", {"users": None}).first()
    assert one.users == sessions.select("user_id").distinct().count()


def test_same_as_the_plain_operator_on_unique_rows(spark, redelivered):
    sessions, _ = redelivered
    unique = sessions.distinct()
    plain = unique.groupBy("device_type").agg(*[c.alias(n) for n, c in traffic.conditional_counts({"g": F.col("utm_source") == "gsearch"}, unique=True).items()])
    got = distinct.distinct_counts(sessions, "website_session_id", {"g": F.col("utm_source") == "gsearch"}, ["device_type"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.collect()))


def test_no_expand_and_two_combined_shuffles(redelivered):
    sessions, _ = redelivered
    plans = [physical(distinct.distinct_counts(sessions, "user_id", conditions(), ["device_type"])),
             physical(distinct.roll_up(distinct.daily_bitmaps(sessions, "user_id", conditions()), list(MEASURES), distinct.grain_keys("month")))]
    for plan in plans:
        assert "Expand" not in plan and "partial_" in plan
        assert plan.count("Exchange hashpartitioning") <= 3
    assert "Expand" in physical(sessions.groupBy("device_type").agg(F.countDistinct("user_id"), F.countDistinct("website_session_id")))


def test_empty_and_null_keys(spark):
    rows = spark.createDataFrame([(None, "a", "2020-01-01"), (3, "a", "2020-01-01"), (3, "b", "2020-01-02")], "k bigint, g string, at string").withColumn(
        "created_at", F.col("at").cast("timestamp_ntz"))
    assert [tuple(r) for r in distinct.distinct_counts(rows, "k", {"n": None}, ["g"]).orderBy("g").collect()] == [("a", 1), ("b", 1)]
    assert distinct.roll_up(distinct.daily_bitmaps(rows, "k", {"n": None}), ["n"]).first().n == 1
    assert distinct.roll_up(distinct.daily_bitmaps(rows.limit(0), "k", {"n": None}), ["n"]).first().n == 0
    with pytest.raises(ValueError):
        distinct.grain_keys("hour")
