"""Skew-safe numbering equals a plain window, whatever the chunk size."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from funnelwise.functions.sequence import chunked_row_number


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunked_row_number_equals_row_number(spark, chunk):
    rng = np.random.default_rng(chunk)
    ids = rng.permutation(400)
    groups = rng.choice([1, 1, 1, 1, 2, 3, 4], size=400)       # group 1 is hot
    df = spark.createDataFrame([(int(g), int(i)) for g, i in zip(groups, ids)], "g long, id long")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    got = chunked_row_number(df, ["g"], "id", "n", chunk=chunk)
    assert sorted(map(tuple, got.select("g", "id", "n").collect())) == \
        sorted(map(tuple, want.select("g", "id", "n").collect()))


try:
    from hypothesis import given, settings, strategies as st
except ImportError:  # pragma: no cover
    given = None


if given is not None:
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10_000)), min_size=1, max_size=60, unique_by=lambda x: x[1]),
           st.integers(1, 50))
    def test_chunked_row_number_property(spark, rows, chunk):
        df = spark.createDataFrame([(g, i) for g, i in rows], "g long, id long")
        got = sorted(map(tuple, chunked_row_number(df, ["g"], "id", "n", chunk=chunk).select("g", "id", "n").collect()))
        want = []
        for g in sorted({g for g, _ in rows}):
            ids = sorted(i for gg, i in rows if gg == g)
            want += [(g, i, n) for n, i in enumerate(ids, start=1)]
        assert got == sorted(want)
