"""Measure how a hot session spreads over tasks, from Spark's event log.

Builds events in which one session holds a third of all rows, derives the shop
tables, runs every registered statement and reads the event log (written to a
fresh scratch folder): for each statement, over its stages that read at least
as many shuffle records as the hot session has pageviews, the largest share
of a stage's records read by one task.
A plan that sent the hot session's raw rows to one task would show a share of
at least the hot session's share of pageviews.

Usage: python tools/skew_check.py [n_events] [--no-broadcast]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 and sys.argv[1].isdigit() else 60000
    no_broadcast = "--no-broadcast" in sys.argv
    from funnelwise import build_session
    from funnelwise.plans.queries import STATEMENTS
    from funnelwise.sources.events_fixture import derive_shop_tables
    from funnelwise.sources.loader import read_shop_tables, write_shop_tables
    from tests.test_skew import skewed_events

    scratch = tempfile.mkdtemp(prefix="funnelwise-skewcheck-")
    logs = os.path.join(scratch, "eventlog")
    os.makedirs(logs)
    events_path = os.path.join(scratch, "events.parquet")
    skewed_events(n).to_parquet(events_path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    conf = {
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": logs,
        "spark.eventLog.compress": "false",
        # Thresholds scaled down with the data, so AQE's skew handling acts
        # here as it would on a cluster with its 256 MB defaults.
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        # Keep partitions as hashed: coalescing small partitions would merge
        # them into few tasks and hide (or fake) the key distribution.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    if no_broadcast:
        conf["spark.sql.autoBroadcastJoinThreshold"] = "-1"
        conf["spark.sql.adaptive.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session("local[8]", shuffle_partitions=16, extra_conf=conf)
    sc = spark.sparkContext
    # The derivation too, with the id chunk scaled to the data (1,024 ids
    # here, 2**20 on a cluster), so the hot session spans many chunks.
    sc.setJobGroup("derive_shop_tables", "derive_shop_tables")
    tables = derive_shop_tables(spark.read.parquet(events_path), chunk=1024)
    write_shop_tables(tables, os.path.join(scratch, "shop"))
    sc.setJobGroup("setup", "setup")
    t = read_shop_tables(spark, os.path.join(scratch, "shop"))
    total_pv = t.pageviews.count()
    hot_pv = t.pageviews.groupBy("website_session_id").count().agg({"count": "max"}).first()[0]
    for name, fn in STATEMENTS.items():
        sc.setJobGroup(name, name)
        fn(t).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, records = {}, defaultdict(list)
    for path in sorted(glob.glob(os.path.join(logs, "**", "*"), recursive=True)):
        if os.path.isdir(path) or not os.path.basename(path).startswith("events_"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    records[ev["Stage ID"]].append(read)
    worst: dict[str, float] = {}
    where: dict[str, str] = {}
    floor = hot_pv  # only stages big enough to hold the hot session can show it
    for sid, reads in records.items():
        group, total = stage_group.get(sid), sum(reads)
        if group and group != "setup" and total >= floor and max(reads) / total > worst.get(group, 0.0):
            worst[group] = max(reads) / total
            where[group] = f"stage {sid}: {len(reads)} tasks, {total} records"
    report = {
        "events": n,
        "pageviews": total_pv,
        "hot_session_share": round(hot_pv / total_pv, 3),
        "broadcast": not no_broadcast,
        "statements_with_big_shuffle_stages": len(worst),
        "max_task_share": {k: round(v, 3) for k, v in sorted(worst.items(), key=lambda kv: -kv[1])},
        "worst_stage": where,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
