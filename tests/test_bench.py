"""bench.py prints one JSON line with the agreed keys (run on the smallest data)."""

import json
import os
import subprocess
import sys

from funnelwise.plans.queries import STATEMENTS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_WARMUP_DIR="/nonexistent")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["n_queries"] == len(STATEMENTS)
    assert abs(d["value"] - sum(v for k, v in d["queries"].items() if k != "derive_shop_tables")) < 0.01
