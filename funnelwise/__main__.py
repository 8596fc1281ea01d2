"""Run the analysis from the command line.

    python -m funnelwise --tables s3://bucket/shop --out s3://bucket/report
    python -m funnelwise --events /root/testdata/sf0.01 --out /tmp/report --only bounce_rate ab_bounce_rate
    python -m funnelwise --list

Each statement's result is written by Spark to ``<out>/<statement>`` in the
chosen format; nothing is collected to the driver.  Intermediate results that
several statements share (the analysis' temporary tables) are written once to
the checkpoint folder and read by each of them (``--no-reuse`` to disable).  Use ``--tables`` for
stored shop tables (see ``sources.read_shop_tables``) or ``--events`` for a
test-data folder whose ``events`` table the shop tables are derived from.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys
import uuid

from funnelwise.plans.queries import STATEMENTS


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="funnelwise", description=__doc__.split("\n\n")[0])
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--tables", help="folder (or database with --table-format table) of the five shop tables")
    src.add_argument("--events", help="test-data folder with events.parquet to derive the shop tables from")
    ap.add_argument("--table-format", default="parquet", help="parquet, csv, orc, json, table or jdbc")
    ap.add_argument("--option", action="append", default=[], help="reader option key=value (repeatable)")
    ap.add_argument("--keys", default="check", choices=["check", "dedupe", "trust"],
                    help="repeated ids in the tables: an error, one row kept, or not looked for")
    ap.add_argument("--source-zone", default="UTC", help="zone whose wall-clock times stored instants stand for")
    ap.add_argument("--out", help="output folder; one sub-folder per statement")
    ap.add_argument("--format", default="parquet", help="output format (parquet, csv, json, orc)")
    ap.add_argument("--only", nargs="*", help="statement names to run (default: all)")
    ap.add_argument("--no-reuse", action="store_true",
                    help="build shared intermediate results inside every statement instead of writing them "
                         "once to the checkpoint folder")
    ap.add_argument("--list", action="store_true", help="list statement names and exit")
    args = ap.parse_args(argv)

    if args.list:
        print("\n".join(STATEMENTS))
        return 0
    if not args.out or not (args.tables or args.events):
        ap.error("--out and one of --tables / --events are required")
    names = args.only or list(STATEMENTS)
    unknown = [n for n in names if n not in STATEMENTS]
    if unknown:
        ap.error(f"unknown statements: {', '.join(unknown)}")

    from pyspark.sql import SparkSession

    from funnelwise.session import DEFAULT_CONF, checkpoint_dir, remove
    from funnelwise.sources.loader import read_shop_tables, tables_for
    spark = SparkSession.builder.appName("funnelwise").getOrCreate()
    # Recommended runtime SQL settings, unless the submitter chose otherwise.
    submitted = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if key.startswith("spark.sql.adaptive.") and not submitted.contains(key):
            spark.conf.set(key, value)
    tables = (read_shop_tables(spark, args.tables, args.table_format, dict(o.split("=", 1) for o in args.option),
                               args.keys, args.source_zone) if args.tables else tables_for(spark, args.events))
    scratch = None
    if not args.no_reuse and len(names) > 1:
        # The analysis' temporary tables: each shared intermediate is written
        # once to a fresh folder in the shared checkpoint folder.
        scratch = f"{checkpoint_dir(spark).rstrip('/')}/funnelwise-report-{uuid.uuid4().hex}"
        tables = dataclasses.replace(tables, scratch=scratch)
    for name in names:
        writer = STATEMENTS[name](tables).write.mode("overwrite").format(args.format)
        if args.format == "csv":
            writer = writer.option("header", "true")
        writer.save(f"{args.out.rstrip('/')}/{name}")
        print(name, file=sys.stderr)
    if scratch:
        remove(spark, scratch)
    return 0


if __name__ == "__main__":
    sys.exit(main())
