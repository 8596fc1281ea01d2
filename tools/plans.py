"""Print plan-shape counts for every registered statement (and optionally the plan).

Usage: python tools/plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = ["Exchange hashpartitioning", "Exchange SinglePartition", "Exchange rangepartitioning", "Expand",
            "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "SortMergeJoin", "BroadcastHashJoin",
            "ShuffledHashJoin", "InMemoryTableScan", "BatchEvalPython", "ArrowEvalPython"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    from funnelwise import build_session
    from funnelwise.plans.queries import STATEMENTS
    from funnelwise.sources.loader import tables_for
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    t = tables_for(spark, sf)
    for name, fn in STATEMENTS.items():
        if names and name not in names:
            continue
        df = fn(t)
        txt = plan_text(df)
        counts = {p: txt.count(p) for p in PATTERNS if txt.count(p)}
        pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", txt)
        print(f"{name:36s} {counts}")
        if names:
            df.explain("formatted")
            print("pushed:", pushed)


if __name__ == "__main__":
    main()
