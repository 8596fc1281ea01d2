"""Funnel with steps in order, against a plain walk over each session's pages."""

import random

import pytest
from pyspark.sql import functions as F

from funnelwise.operators import funnel
from tests.test_plans import physical

STEPS = {"a": "/a", "b": "/b", "c": "/c", "b2": "/b"}  # one page may be two steps


def walk(pages):
    n, urls = 0, list(STEPS.values())
    for url in pages:
        if n < len(urls) and url == urls[n]:
            n += 1
    return tuple(int(i < n) for i in range(len(urls)))


def tables(spark, seed=1, sessions=40, hot=0):
    rng = random.Random(seed)
    rows, ids = [], 0
    for _ in range(sessions * 12):
        ids += rng.randint(1, 3)
        rows.append((ids, rng.randrange(sessions), rng.choice(["/a", "/b", "/c", "/x", None])))
    for _ in range(hot):
        ids += 1
        rows.append((ids, 0, rng.choice(["/a", "/b", "/x"])))
    df = spark.createDataFrame(rows, "website_pageview_id bigint, website_session_id bigint, pageview_url string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    return rows, df.repartition(7)


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_without_an_entry(spark, chunk):
    rows, views = tables(spark)
    entries = spark.createDataFrame([(i,) for i in range(45)], "website_session_id bigint")  # some without pages
    got = {r[0]: tuple(r)[1:] for r in funnel.ordered_funnel(entries, views, STEPS, chunk=chunk).collect()}
    assert got == {i: walk([u for p, s, u in sorted(rows) if s == i]) for i in range(45)}


@pytest.mark.parametrize("chunk", [5, 4096])
def test_after_an_entry_by_product(spark, chunk):
    rows, views = tables(spark, 2)
    entries = [(i, kind, start) for i in range(30) for kind, start in (("x", 100), (None, 300), ("y", 500))]
    df = spark.createDataFrame(entries, "website_session_id bigint, kind string, start bigint")
    got = {(r[0], r[1]): tuple(r)[2:] for r in funnel.ordered_funnel(df, views, STEPS, by=["kind"], after="start", chunk=chunk).collect()}
    assert got == {(i, kind): walk([u for p, s, u in sorted(rows) if s == i and p > start]) for i, kind, start in entries}


def test_order_matters(spark):
    views = spark.createDataFrame([(1, 1, "/b"), (2, 1, "/a"), (3, 1, "/c"), (4, 2, "/a"), (5, 2, "/x"), (6, 2, "/b")],
                                  "website_pageview_id bigint, website_session_id bigint, pageview_url string")
    entries = spark.createDataFrame([(1,), (2,)], "website_session_id bigint")
    steps = {"a": "/a", "b": "/b"}
    assert sorted(map(tuple, funnel.ordered_funnel(entries, views, steps).collect())) == [(1, 1, 0), (2, 1, 1)]
    assert sorted(map(tuple, funnel.funnel(entries, views, steps).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_a_hot_session_is_walked_in_chunks(spark):
    rows, views = tables(spark, 3, hot=400)
    entries = spark.createDataFrame([(i,) for i in range(40)], "website_session_id bigint")
    got = {r[0]: tuple(r)[1:] for r in funnel.ordered_funnel(entries, views, STEPS, chunk=50).collect()}
    assert got == {i: walk([u for p, s, u in sorted(rows) if s == i]) for i in range(40)}
    plan = physical(funnel.ordered_funnel(entries, views, STEPS, chunk=50))
    assert "Window" not in plan
    # pages are shuffled by session and chunk, arrays of chunks by session
    assert "_chunk" in plan.split("Exchange hashpartitioning(website_session_id")[-1][:200]


def test_after_a_join_pages_are_dealt_by_chunk_too(spark):
    _, views = tables(spark, 4)
    entries = spark.createDataFrame([(1, "x", 2)], "website_session_id bigint, kind string, start bigint")
    plan = physical(funnel.ordered_funnel(entries, views, STEPS, by=["kind"], after="start"))
    assert any("_chunk" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
