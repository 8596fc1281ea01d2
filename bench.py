"""Benchmark: every registered statement on the tables derived from $BENCH_SF_DIR.

Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

* an untimed warm-up runs everything once on ``$BENCH_WARMUP_DIR``
  (default sf0.001) so JVM start-up is not charged to the first query.
* ``derive_shop_tables``: events -> five shop tables, written as Parquet to
  the shared checkpoint folder (once per run).
* each statement: executed in full with the ``noop`` sink (no collect to the
  driver); best of ``$BENCH_REPEAT`` runs (default 2), so JVM warm-up of the
  first run is not charged to one query.
``value`` is the sum of the per-statement times (derivation excluded; it is
reported separately).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from funnelwise import build_session  # noqa: E402
from funnelwise.plans.queries import STATEMENTS  # noqa: E402
from funnelwise.sources.loader import tables_for  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    partitions = int(cpus) if cpus.isdigit() else (os.cpu_count() or 8)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=partitions,
                          extra_conf={"spark.driver.memory": "8g"})

    # Untimed warm-up (JVM start, code generation caches) on the smallest data.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        warm = tables_for(spark, warm_dir)
        for fn in STATEMENTS.values():
            fn(warm).write.format("noop").mode("overwrite").save()

    t0 = time.perf_counter()
    tables = tables_for(spark, sf_dir)
    derive = time.perf_counter() - t0

    times: dict[str, float] = {}
    for name, fn in STATEMENTS.items():
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            fn(tables).write.format("noop").mode("overwrite").save()
            el = time.perf_counter() - t
            best = el if best is None else min(best, el)
        times[name] = round(best, 4)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_sec",
        "value": total,
        "unit": "sec",
        "queries": {"derive_shop_tables": round(derive, 3), **times},
        "sf": float(m.group(1)) if m else sf_dir,
        "n_queries": len(times),
        "timing": f"best of {repeat} per statement, noop sink, local[{cpus}]",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
