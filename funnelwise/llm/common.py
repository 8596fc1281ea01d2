"""Helpers shared by the operators: words, hashes, staged tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from funnelwise.session import checkpoint_dir

# Bytes that separate words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] in
# lower-cased UTF-8 become spaces: every byte of a non-ASCII character is
# >= 0x80, so the class holds for bytes as it does for code points.
_ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_CACHE_WORDS = 1_000_000


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.lower().translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null has none."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (wrapping arithmetic on uint64 arrays)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; the whole sequence as one
    when it is shorter; nothing for no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i:n - size + 1 + i])
    return np.unique(out)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def ids_and_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id bigint, text string): whatever else the table carries stays behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null ids: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(m)


class Shipped:
    """A broadcast object of this package: its plain fields are broadcast, and the object is
    made again in the task, as a broadcast instance would ask the executors to import its class."""

    def __init__(self, spark: SparkSession, thing: object):
        self._kind, self._fields = type(thing), spark.sparkContext.broadcast(vars(thing))

    @property
    def value(self):
        thing = object.__new__(self._kind)
        vars(thing).update(self._fields.value)
        return thing


_FOLDERS: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder; removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_dir(spark).rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:12]}"
        atexit.register(drop_folder, spark, _FOLDERS[app])
    return _FOLDERS[app]


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a staged folder through Hadoop's file system (quietly when Spark has ended)."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage with files every executor sees, so a lost executor costs
    task retries only, and gives later joins a plain scan on that side, which
    lets adaptive execution split a hot key.
    """
    path = f"{stage_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn, schema: str, per_task: bool = False) -> DataFrame:
    """``mapInArrow`` for a function of one record batch that returns a dict of columns
    (lists or arrays) or None; with ``per_task``, ``fn()`` makes that function once a task."""
    fields = schema_of(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn() if per_task else fn
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)
