"""Stored copies of intermediate results, as the analysis' temporary tables are.

``CREATE TEMPORARY TABLE t AS SELECT ...`` is a snapshot: made once, read many times.  A
copy lies at ``<folder>/<name>/<key>/<attempt>``.

* The key is a hash of the statement's name and parameters and of what its inputs
  are made of: the names of their files, and each input folder's size and time of change.  Changed
  inputs or parameters have another key, so a copy is never read for what it wasn't made from.
* An attempt is complete once its mark is written, after Spark has committed all its files.  Readers
  take the first complete attempt; a half-written one has no mark and is never read.
  Two applications that write at once leave two complete attempts with the same rows.
* A later application finds the copy by its key and reads it instead of computing it again.

Inputs without files (rows made by the program) can't be told apart across
applications; their copies are found by the tables object that made them only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

MARK = "_COMPLETE"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(inputs: Mapping[str, DataFrame]) -> str | None:
    """Hash of the files that the tables are read from; None if one has no files."""
    digest, folders = hashlib.sha256(), set()
    for name, df in sorted(inputs.items()):
        files = sorted(df.inputFiles())
        if not files:
            return None
        digest.update(json.dumps([name, files]).encode())
        folders.update(f.rpartition("/")[0] for f in files)
    spark = next(iter(inputs.values())).sparkSession
    for folder in sorted(folders):
        path, fs = _path(spark, folder)
        size = fs.getContentSummary(path)
        digest.update(json.dumps([folder, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()]).encode())
    return digest.hexdigest()


def snapshot_key(name: str, parameters: Sequence[object], inputs_key: str) -> str:
    """The folder name of a copy."""
    return hashlib.sha256(json.dumps([name, [repr(p) for p in parameters], inputs_key]).encode()).hexdigest()[:32]


def complete_copies(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the complete attempts below ``<folder>/<name>/<key>``, in order."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    attempts = sorted(str(s.getPath()) for s in fs.listStatus(path) if s.isDirectory())
    return [a for a in attempts if fs.exists(_path(spark, f"{a}/{MARK}")[0])]


def snapshot(spark: SparkSession, folder: str, name: str, parameters: Sequence[object], inputs_key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored copy of ``build()``, made now if there is no complete one."""
    home = f"{folder.rstrip('/')}/{name}/{snapshot_key(name, parameters, inputs_key)}"
    found = complete_copies(spark, home)
    if not found:
        attempt = f"{home}/{uuid.uuid4().hex}"
        build().write.parquet(attempt)
        path, fs = _path(spark, f"{attempt}/{MARK}")
        fs.create(path).close()
        found = [attempt]
    return spark.read.parquet(found[0])


def drop_others(spark: SparkSession, folder: str, name: str, keep: str) -> int:
    """Remove copies of ``name`` under other keys than ``keep``, and what was left half-written under it; how many."""
    path, fs = _path(spark, f"{folder.rstrip('/')}/{name}")
    if not fs.exists(path):
        return 0
    gone = 0
    for status in fs.listStatus(path):
        if status.getPath().getName() != keep:
            gone += bool(fs.delete(status.getPath(), True))
            continue
        whole = set(complete_copies(spark, str(status.getPath())))
        gone += sum(bool(fs.delete(s.getPath(), True)) for s in fs.listStatus(status.getPath()) if str(s.getPath()) not in whole)
    return gone
