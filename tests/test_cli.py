"""python -m funnelwise: list and run statements, writing results with Spark."""

import os
import tempfile

from funnelwise.__main__ import main
from funnelwise.plans.queries import STATEMENTS


def test_list(capsys):
    assert main(["--list"]) == 0
    assert len(capsys.readouterr().out.split()) == len(STATEMENTS)


def test_run_two_statements(spark):
    out = tempfile.mkdtemp(prefix="funnelwise-cli-")
    assert main(["--events", "/root/testdata/sf0.001", "--out", out, "--only", "bounce_rate",
                 "quarterly_volume"]) == 0
    assert sorted(os.listdir(out)) == ["bounce_rate", "quarterly_volume"]
    assert spark.read.parquet(f"{out}/quarterly_volume").count() > 0


def test_shared_intermediates_give_the_same_results(spark):
    import dataclasses

    import duckdb

    import __spark_entry__ as E
    from funnelwise.sources.loader import tables_for
    from tests.shopgen import multiset
    sf = "/root/testdata/sf0.01"
    t = dataclasses.replace(tables_for(spark, sf), scratch=tempfile.mkdtemp(prefix="funnelwise-scratch-"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    bad = []
    for name, fn in STATEMENTS.items():
        df = fn(t)
        cur = con.execute(E.oracle_sql()[name])
        d_cols = [d[0] for d in cur.description]
        if multiset(df.columns, [tuple(r) for r in df.collect()]) != multiset(d_cols, cur.fetchall()):
            bad.append(name)
    assert bad == []
    assert "sessions_seeing_cart" in os.listdir(t.scratch)
