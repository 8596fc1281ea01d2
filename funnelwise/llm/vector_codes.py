"""Product codes of vectors, trained with per-dimension value dictionaries.

Components become integers ``floor(scale * x)``; a vector is cut into equal
consecutive parts, and each part is coded by its nearest codebook entry.  Vectors are
stored once in blocks: per dimension the block's distinct integers (its
dictionary) and each vector's position in it.  A training or coding pass then
tabulates, for every distinct integer of a dimension, the squared differences to all
entries, and a part's distances are gathers from these tables, added over
the part's dimensions.  New entries are component sums and counts, added up per
task, then over tasks; only these (entries x dimensions numbers) reach the driver.

All arithmetic is in integers: int64 where no sum can leave it, Python's integers
for blocks with larger values.

Defined results: rows whose vector is null or holds null or non-finite components
are dropped; the dimension is that of the first kept vector (by vec_id, nulls last) whose
length is a multiple of the number of parts and not 0, and kept vectors of another
length, or all if there is no such vector, have a null code and error; with fewer vectors than
entries the codebook has as many entries as vectors; equal vec_ids are ordered by their vectors;
repeated rows each get a row; integers beyond +-2^62 count as that, and errors beyond
2^63 - 1 as that; null labels are one label; other columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.llm.common import schema_of, staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Values of a block (vectors x dimensions).
BLOCK_VALUES = 1 << 18
_EDGE = 2**62
_LONG = 2**63 - 1


@dataclass
class Codebook:
    """entries: integers of shape (dimensions, entries); part p owns an equal run of dimensions."""

    entries: np.ndarray
    parts: int

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry, position within the part."""
        dims, n = self.entries.shape
        by_part = self.entries.reshape(self.parts, dims // self.parts, n).transpose(0, 2, 1)
        return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str, scale: int = SCALE) -> list[float]:
        """The vector that a code stands for."""
        dims = self.entries.shape[0] // self.parts
        picks = [int(code[2 * p:2 * p + 2], 16) for p in range(self.parts)]
        return [float(self.entries[p * dims + d, e]) / scale for p, e in enumerate(picks) for d in range(dims)]


def _kept(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -_EDGE, _EDGE).astype(np.int64)


def first_entries(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """Integers of the ``entries`` smallest ids' vectors, shape (dimensions, found); empty if no vector fits."""
    fits = vectors.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    one = fits.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not one:
        return np.zeros((0, 0), np.int64)
    same = fits.filter(F.size("vector") == len(one[0]["vector"]))
    rows = same.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # at most ``entries`` rows
    return _integers(np.array([r["vector"] for r in rows], float).T, scale)


def _block(ints: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Dictionary sizes, dictionaries and codes of a block of vectors (rows) by dimension (columns)."""
    sizes, values, codes = [], [], []
    for column in ints.T:
        value, code = np.unique(column, return_inverse=True)
        sizes.append(len(value))
        values.append(value)
        codes.append(code.astype(np.uint16))  # a block has at most 65,536 vectors
    return sizes, np.concatenate(values).tobytes(), np.concatenate(codes).tobytes()


def blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Vectors of ``dims`` components as rows (vec_ids, labels, sizes, dictionaries, codes) of at most BLOCK_VALUES values."""
    label = vectors.schema["label"].dataType.simpleString()
    ddl = f"vec_ids array<bigint>, labels array<{label}>, sizes array<int>, dictionaries binary, codes binary"
    schema, step = schema_of(vectors.sparkSession, ddl), max(1, min(65_536, BLOCK_VALUES // max(1, dims)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                flat = piece.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
                sizes, dictionaries, codes = _block(_integers(flat.reshape(piece.num_rows, dims), scale))
                row = [[piece.column(0).to_pylist()], [piece.column(1).to_pylist()], [sizes], [dictionaries], [codes]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    return vectors.filter(F.size("vector") == dims).select("vec_id", "label", "vector").mapInArrow(run, ddl)


def _assign(sizes: list[int], dictionaries: bytes, codes: bytes, entries: np.ndarray, parts: int):
    """Of a block: (dimension -> (distinct integers, codes)), picks (parts, vectors), squared distances to them."""
    dims, total = len(sizes), np.frombuffer(dictionaries, np.int64)
    codes_of = np.frombuffer(codes, np.uint16).reshape(dims, -1)
    n = codes_of.shape[1]
    most = max(int(np.abs(total).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int64 if (2 * most) ** 2 * dims <= _LONG else object
    ends = np.cumsum(sizes)
    per_dim = [(total[e - s:e], codes_of[d]) for d, (s, e) in enumerate(zip(sizes, ends))]
    picks, errors = [], []
    run = dims // parts
    for p in range(parts):
        distance = 0
        for d in range(p * run, (p + 1) * run):
            table = (per_dim[d][0].astype(kind)[:, None] - entries[d].astype(kind)[None, :]) ** 2  # distinct integers x entries
            distance = distance + table[per_dim[d][1]]
        pick = distance.argmin(axis=1)  # the first of equals
        picks.append(pick)
        errors.append(distance[np.arange(n), pick])
    return per_dim, picks, errors


def _round(stored: DataFrame, book: Codebook) -> np.ndarray:
    """New entries: floor of the mean of each entry's parts; unused entries stay."""
    entries, parts = book.entries, book.parts
    dims, n = entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((dims, n), object), np.zeros((parts, n), np.int64)
        for batch in batches:
            for sizes, dictionaries, codes in zip(*(c.to_pylist() for c in batch.columns)):
                per_dim, picks, _ = _assign(sizes, dictionaries, codes, entries, parts)
                for p, pick in enumerate(picks):
                    counts[p] += np.bincount(pick, minlength=n)
                    for d in range(p * dims // parts, (p + 1) * dims // parts):
                        values, code = per_dim[d]
                        # how often each distinct integer meets each entry, times the integer
                        seen = np.bincount(pick * len(values) + code, minlength=n * len(values)).reshape(n, -1)
                        wide = int(np.abs(values).max()) * len(code) > _LONG
                        sums[d] += (seen.astype(object) @ values.astype(object)) if wide else (seen @ values).astype(object)
        used = [(d, e) for d in range(dims) for e in range(n) if counts[d * parts // dims, e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([Decimal(int(sums[d, e])) for d, e in used], pa.decimal128(38, 0)), pa.array([int(counts[d * parts // dims, e]) for d, e in used], pa.int64())],
            names=["d", "e", "total", "n"])

    sums = stored.select("sizes", "dictionaries", "codes").mapInArrow(run, "d int, e int, total decimal(38,0), n bigint")
    new = entries.copy()
    for r in sums.groupBy("d", "e").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # entries x dimensions rows
        new[r["d"], r["e"]] = int(r["total"]) // r["n"]
    return new


def train(stored: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> Codebook:
    """``rounds`` of assignment and new means over all blocks."""
    book = Codebook(first, parts)
    for _ in range(rounds):
        book = Codebook(_round(stored, book), parts)
    return book


def encode(stored: DataFrame, book: Codebook, label: str) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every stored vector."""
    entries, parts = book.entries, book.parts
    ddl = f"vec_id bigint, label {label}, code string, error bigint"
    schema = schema_of(stored.sparkSession, ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, sizes, dictionaries, codes in zip(*(c.to_pylist() for c in batch.columns)):
                _, picks, errors = _assign(sizes, dictionaries, codes, entries, parts)
                hexes = np.stack(picks, axis=1).astype(np.uint8)
                total = [min(_LONG, int(x)) for x in sum(e.astype(object) for e in errors)]
                row = [ids, labels, [h.tobytes().hex() for h in hexes], total]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    return stored.select("vec_ids", "labels", "sizes", "dictionaries", "codes").mapInArrow(run, ddl)


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             vector: str = "embedding") -> DataFrame:
    """The contract's rows: vec_id, code, error, label_error, codebooks_sha256."""
    assert entries <= 256, "a code has two hex digits a part"
    kind = embeddings.schema["label"].dataType.simpleString()
    kept = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("vector")).filter(_kept(F.col("vector")))
    first = first_entries(kept, parts, entries, scale)
    dims = first.shape[0]
    book = Codebook(first, parts)
    other = kept.filter(F.size("vector") != dims) if dims else kept
    rows = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if dims:
        stored = staged(blocks(kept, dims, scale), "blocks")
        book = train(stored, first, parts, rounds)
        rows = encode(stored, book, kind).unionByName(rows)
    coded = staged(rows, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))  # added up per task first
    full = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return full.select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))
