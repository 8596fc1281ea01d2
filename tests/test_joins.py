"""The helpers for rows of a key set against plain definitions, and their plans."""

import pytest
from pyspark.sql import functions as F

from funnelwise.functions.joins import aggregate_for_keys, join_keyed, key_range, per_key, rekeyed

KEY = "website_session_id"


@pytest.fixture(scope="module")
def data(spark):
    rows = [(s, i, s % 3) for s in range(1, 40) for i in range(s % 7)]
    keys = [(s,) for s in range(5, 30, 2)] + [(5,)]
    return rows, keys, spark.createDataFrame(rows, f"{KEY} long, id long, g int"), spark.createDataFrame(keys, f"{KEY} long")


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("by", [(), ("g",)])
def test_aggregates(data, by):
    rows, keys, r, k = data
    want = {}
    for s, i, g in rows:
        n, top = want.get((s, g), (0, -1))
        want[s, g] = (n + 1, max(top, i))
    aggs = [F.count("id").alias("n"), F.max("id").alias("top")]
    key = (lambda s, g: (s, g)) if by else (lambda s, g: (s,))
    exact = aggregate_for_keys(r, k, KEY, *aggs, by=by)
    assert sorted_rows(exact) == sorted((*key(s, g), n, t) for (s, g), (n, t) in want.items() if (s,) in keys)
    ranged = per_key(r, k, KEY, *aggs, by=by)
    assert sorted_rows(ranged) == sorted((*key(s, g), n, t) for (s, g), (n, t) in want.items() if 5 <= s <= 29)


def test_join_and_range(data):
    rows, keys, r, k = data
    anchors = k.groupBy(KEY).agg(F.lit(2).alias("_anchor"))
    assert sorted_rows(join_keyed(r, anchors, KEY)) == sorted((*x, 2) for x in rows if (x[0],) in keys)
    assert join_keyed(r, anchors, KEY, range_of=k).count() == sum((x[0],) in keys for x in rows)
    assert key_range(r, k.limit(0), KEY).count() == 0
    assert sorted_rows(rekeyed(k, KEY)) == sorted(keys)


def test_both_sides_of_a_join_are_fresh_shuffles(spark, data):
    _, _, r, k = data
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_keyed(r, k.groupBy(KEY).agg(F.lit(2).alias("_anchor")), KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan[plan.index("SortMergeJoin"):].splitlines()
    sides = [i for i, line in enumerate(join) if "Sort [" in line]
    assert len(sides) == 2 and all("Exchange hashpartitioning" in join[i + 1] for i in sides)
