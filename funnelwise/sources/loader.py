"""Loading the shop tables.

``read_shop_tables`` reads stored tables (Parquet, CSV, ORC or JSON folders,
or catalog tables) with the fixed schemas.  ``tables_for`` builds them from
a test-data folder's ``events`` once per application, writes them to the
shared folder named by ``spark.checkpoint.dir`` and reads them back, so
every later query scans Parquet (with filter pushdown and column pruning)
instead of re-deriving them, and no lineage back to ``events`` is kept.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from funnelwise.session import checkpoint_dir, remove, remove_at_exit
from funnelwise.sources.events_fixture import derive_shop_tables
from funnelwise.sources.schema import PRIMARY_KEYS, SCHEMAS, ShopTables, check_keys, conform

_CACHE: dict[tuple[str, str], ShopTables] = {}
_LOCK = threading.Lock()


KEYS = ("check", "dedupe", "trust")


def with_unique_keys(tables: ShopTables, keys: str) -> ShopTables:
    """The tables with unique primary keys, which every count relies on.

    ``check``: one aggregate per table; repeated keys are an error that names the
    table.  ``dedupe``: one row of each key stays (any of them; meant for re-delivered
    rows).  ``trust``: taken as they are.
    """
    if keys not in KEYS:
        raise ValueError(f"keys must be one of {KEYS}")
    if keys == "check":
        repeated = {name: n for name, n in check_keys(tables).items() if n}
        if repeated:
            raise ValueError("repeated keys: " + ", ".join(f"{name}.{PRIMARY_KEYS[name]} ({n})" for name, n in repeated.items()))
    if keys != "dedupe":
        return tables
    unique = {name: df.dropDuplicates([PRIMARY_KEYS[name]]) if name in PRIMARY_KEYS else df for name, df in tables.as_dict().items()}
    return ShopTables(*unique.values(), scratch=tables.scratch)


def jdbc_options(name: str, location: str, options: dict[str, str]) -> dict[str, str]:
    """Reader options of one table in a database: ``location`` is its schema (may be empty).

    ``options`` holds url, driver, user and so on.  With ``numPartitions`` and
    bounds given as ``<table>.lowerBound`` / ``<table>.upperBound`` the read is split
    on the table's key.
    """
    out = {k: v for k, v in options.items() if "." not in k}
    out["dbtable"] = f"{location}.{name}" if location else name
    bounds = {b: options[f"{name}.{b}"] for b in ("lowerBound", "upperBound") if f"{name}.{b}" in options}
    if name in PRIMARY_KEYS and "numPartitions" in out and len(bounds) == 2:
        return out | bounds | {"partitionColumn": PRIMARY_KEYS[name]}
    out.pop("numPartitions", None)
    return out


MALFORMED = ("error", "quarantine", "trust")
BROKEN = "_broken_record"


def malformed_rows(parsed: DataFrame, schema: StructType) -> DataFrame:
    """file, record: rows of a text table that don't fit its schema, or lack a required value.

    ``parsed`` has the schema's columns, ``_broken_record`` and ``_file``.
    """
    missing = reduce(lambda a, b: a | b, [F.col(f.name).isNull() for f in schema.fields if not f.nullable], F.lit(False))
    whole = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*schema.fieldNames())))
    return parsed.filter(F.col(BROKEN).isNotNull() | missing).select(F.col("_file").alias("file"), whole.alias("record"))


def read_text_table(spark: SparkSession, path: str, fmt: str, schema: StructType, options: dict[str, str], malformed: str,
                    quarantine: str | None) -> DataFrame:
    """A CSV or JSON table in its schema, with a check of every row.

    ``error``: broken rows are an error that names files and their counts; ``quarantine``: they
    are written to ``quarantine`` (file, record) and left out; ``trust``: Spark's own
    reading, where a bad value becomes NULL.
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed must be one of {MALFORMED}")
    if malformed == "trust":
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    if malformed == "quarantine" and not quarantine:
        raise ValueError("name a folder for the broken rows")
    # all columns are parsed in every pass, so that a row is judged alike whatever a statement reads of it
    checked = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "columnPruning": "false"}
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema.fields] + [StructField(BROKEN, StringType(), True)])
    parsed = spark.read.format(fmt).options(**(options | checked)).schema(loose).load(path).select("*", F.col("_metadata.file_path").alias("_file"))
    broken = malformed_rows(parsed, schema)
    if malformed == "error":
        counts = broken.groupBy("file").agg(F.count("record").alias("n")).orderBy(F.desc("n"), "file").limit(20).collect()
        if counts:
            raise ValueError("broken rows: " + ", ".join(f"{r['file']} ({r['n']})" for r in counts))
    else:
        broken.write.mode("append").parquet(quarantine)
    required = [f.name for f in schema.fields if not f.nullable]
    return parsed.filter(F.col(BROKEN).isNull()).dropna(subset=required).select(*schema.fieldNames())


def read_shop_tables(spark: SparkSession, location: str, fmt: str = "parquet", options: dict[str, str] | None = None, keys: str = "trust",
                     source_zone: str = "UTC", malformed: str = "trust", quarantine: str | None = None, collation: str | None = None) -> ShopTables:
    """Read the five tables from ``location/<table name>`` in ``fmt``.

    ``fmt="table"`` reads catalog tables named ``<location>.<table name>``
    (``location`` is the database), ``fmt="jdbc"`` database tables (see
    ``jdbc_options``).  File formats get the fixed schema, so nothing is inferred
    by scanning.  ``keys``: see ``with_unique_keys``.  ``source_zone``: the zone
    whose wall-clock times stored instants stand for.  ``malformed`` (CSV and JSON): see
    ``read_text_table``; broken rows of a table go to ``<quarantine>/<table name>``.
    ``collation``: see ``conform``.
    """
    frames = {}
    for name, schema in SCHEMAS.items():
        if fmt == "table":
            df = spark.table(f"{location}.{name}")
        elif fmt == "jdbc":
            df = spark.read.format("jdbc").options(**jdbc_options(name, location, options or {})).load()
        elif fmt in ("parquet", "orc"):
            df = spark.read.format(fmt).options(**(options or {})).load(f"{location.rstrip('/')}/{name}")
        else:
            aside = f"{quarantine.rstrip('/')}/{name}" if quarantine else None
            df = read_text_table(spark, f"{location.rstrip('/')}/{name}", fmt, schema, options or {}, malformed, aside)
        frames[name] = conform(df, schema, source_zone, collation)
    return with_unique_keys(ShopTables(
        sessions=frames["website_sessions"],
        pageviews=frames["website_pageviews"],
        orders=frames["web_orders"],
        order_items=frames["order_items"],
        refunds=frames["order_item_refunds"],
    ), keys)


def write_shop_tables(tables: ShopTables, location: str, mode: str = "errorifexists",
                      files: int | None = None, max_records_per_file: int = 20_000_000) -> None:
    """Write the five tables as Parquet under ``location``, clustered by time.

    Nearly every analysis filters on a ``created_at`` window, so each table
    with that column is range-partitioned and sorted by it: the Parquet
    min/max statistics of a file and of a row group then cover a narrow time
    span, and the pushed-down window predicate skips everything outside the
    window.  Session and pageview ids rise with time, so the files are close
    to session order as well.  ``files`` (range partitions) defaults to the
    shuffle partitions; a partition larger than ``max_records_per_file`` rows
    is written as several files, each still sorted.
    """
    spark = tables.sessions.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in tables.as_dict().items():
        out = df
        if "created_at" in df.columns:
            out = df.repartitionByRange(n, "created_at").sortWithinPartitions("created_at")
        (out.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
         .parquet(f"{location.rstrip('/')}/{name}"))


def write_periods(results: DataFrame, location: str, periods: Sequence[str], max_records_per_file: int = 20_000_000) -> None:
    """Write a report's rows as Parquet below ``location``, one folder per period (``periods``: its columns).

    Only the folders of the periods in ``results`` are replaced (dynamic partition overwrite), so a
    rerun of one month leaves the files of all others untouched.  Each period's rows are dealt to
    the tasks by period and a hash of the row, so a long period is several files.
    """
    rows = [c for c in results.columns if c not in periods]
    spread = F.pmod(F.xxhash64(*rows) if rows else F.lit(0), F.lit(8))
    (results.repartition(*periods, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", max_records_per_file).partitionBy(*periods).parquet(location))


def tables_for(spark: SparkSession, sf_dir: str, materialize: bool = True) -> ShopTables:
    """The shop tables derived from ``<sf_dir>/events.parquet``.

    Built once per Spark application and folder.  With ``materialize`` the
    derived tables are written to a fresh folder inside the shared
    checkpoint folder, read back, and removed when the application ends.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    with _LOCK:
        cached = _CACHE.get(key)
        if cached is not None:
            return cached
        events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
        if not materialize:
            tables = derive_shop_tables(events)
        else:
            target = f"{checkpoint_dir(spark).rstrip('/')}/funnelwise-shop-{uuid.uuid4().hex}"
            remove_at_exit(spark, target)

            def stage(name, df):
                path = f"{target}/_stage/{name}"
                df.write.parquet(path)
                return spark.read.parquet(path)

            write_shop_tables(derive_shop_tables(events, stage=stage), target)
            remove(spark, f"{target}/_stage")
            tables = read_shop_tables(spark, target)
        _CACHE[key] = tables
        return tables
