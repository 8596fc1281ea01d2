"""Plan shape of every registered statement.

* no Expand (multi-column COUNT DISTINCT), no nested-loop or cartesian join
* no window operator over a whole session or user (chunk windows only)
* filters of windowed statements reach the Parquet scan; scans read only
  the columns they need
"""

import re

import pytest

from funnelwise.plans.queries import STATEMENTS
from funnelwise.sources.loader import tables_for

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    # Show whole scan metadata (PushedFilters, ReadSchema) in plan strings.
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield tables_for(spark, SF)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def unbounded_windows(plan: str) -> list[str]:
    """Window operators not bounded by chunks.

    Allowed: windows over (group, chunk) partitions (at most ``chunk`` rows)
    and windows over the per-chunk table (``_chunk`` / ``_c*`` columns),
    which is ``chunk`` times smaller than its input.
    """
    out = []
    for line in plan.splitlines():
        if "Window [" in line and not ("_chunk" in line or re.search(r"\b_c(\d+|max|min|nt)#", line)):
            out.append(line.strip()[:200])
    return out


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_no_expand_no_pairs_no_unbounded_window(tables, name):
    plan = physical(STATEMENTS[name](tables))
    for bad in ("Expand", "BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
    assert unbounded_windows(plan) == []


@pytest.mark.parametrize("name", ["traffic_top_sources", "weekly_sessions", "funnel_session_flags",
                                  "hour_weekday_heatmap", "monthly_sales", "sessions_seeing_cart"])
def test_time_window_is_pushed_to_scan(tables, name):
    plan = physical(STATEMENTS[name](tables))
    pushed = " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", plan))
    assert "created_at" in pushed and ("LessThan" in pushed or "GreaterThan" in pushed), pushed


def test_scans_are_pruned(tables):
    plan = physical(STATEMENTS["funnel_session_flags"](tables))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(s.count(":") <= 4 for s in schemas), schemas
    assert all("http_referer" not in s and "device_type" not in s for s in schemas)


@pytest.mark.parametrize("name", ["bounce_rate", "ab_bounce_rate", "funnel_session_flags", "next_pageview_id", "urls_after_product_page",
                                  "product_funnel_counts", "cross_sell_pre_post", "billing_ab_conversion", "session_lander_and_time"])
def test_key_range_reaches_the_scan(tables, name):
    """Pageviews or orders of some sessions are read in the range of their ids."""
    plan = physical(STATEMENTS[name](tables))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "website_session_id" in line.split("DataFilters")[-1]]
    assert any("Subquery" in line.split("DataFilters")[-1] or "subquery" in line.split("DataFilters")[-1] for line in scans), plan
