"""Skew-safe sequence helpers.

A plain ``row_number()`` over ``partitionBy(group)`` sends every row of a
group to one task: a group holding a third of the data becomes one task
holding a third of the data.  Here rows are cut into chunks
``order_col div chunk`` (at most ``chunk`` rows of a group per chunk);
numbers are counted inside each chunk and shifted by the rows of the group
in earlier chunks, which come from a per-chunk count table ``chunk`` times
smaller than the input.  Every shuffle key of the input includes the chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_CHUNK = 1 << 20
CHUNK = "_chunk"
OFFSET = "_offset"


def with_chunk(df: DataFrame, order_col: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``_chunk = order_col div chunk``: at most ``chunk`` rows of a group per chunk."""
    return df.withColumn(CHUNK, F.floor(F.col(order_col) / F.lit(chunk)).cast("long"))


def chunk_offsets(chunked: DataFrame, group_cols: Sequence[str],
                  chunk_aggs: Mapping[str, Column] | None = None,
                  group_values: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (group, chunk) with ``_offset``: rows of the group in earlier chunks.

    ``chunk_aggs`` are aggregates per chunk (map-side combined);
    ``group_values`` are window expressions over the chunk rows of the group
    (use ``group_window(group_cols)``), e.g. the group's minimum id.  The
    windows here run over the small chunk table, never over input rows.
    """
    keys = list(group_cols)
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [c.alias(n) for n, c in (chunk_aggs or {}).items()]
    per_chunk = chunked.groupBy(*keys, CHUNK).agg(*aggs)
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        "*",
        F.coalesce(F.sum("_cnt").over(prior), F.lit(0).cast("long")).alias(OFFSET),
        *[c.alias(n) for n, c in (group_values or {}).items()],
    )


def group_window(group_cols: Sequence[str]) -> Window:
    """All chunk rows of a group (use on the chunk table only)."""
    return Window.partitionBy(*group_cols)


def prior_chunks(group_cols: Sequence[str]) -> Window:
    """Chunk rows of the group before the current chunk (use on the chunk table only)."""
    return Window.partitionBy(*group_cols).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def before_in_chunk(group_cols: Sequence[str], order_col: str) -> Window:
    """Rows of the same (group, chunk) before the current row: at most ``chunk`` rows."""
    return (Window.partitionBy(*group_cols, CHUNK).orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, -1))


def number_in_chunks(chunked: DataFrame, offsets: DataFrame, group_cols: Sequence[str], order_col: str,
                     out_col: str = "n", carry: Sequence[str] = ()) -> DataFrame:
    """Attach ``out_col`` (1-based position in the group by ``order_col``) and ``carry`` columns.

    One shuffle of the input, keyed by (group, chunk); the window reuses
    that partitioning and sorts at most ``chunk`` rows per key.
    """
    keys = [*group_cols, CHUNK]
    table = offsets.select(*keys, OFFSET, *carry)
    inner = Window.partitionBy(*keys).orderBy(order_col)
    return (chunked.join(table, keys, "inner")
            .withColumn(out_col, (F.col(OFFSET) + F.row_number().over(inner)).cast("long"))
            .drop(CHUNK, OFFSET))


def chunked_row_number(df: DataFrame, group_cols: Sequence[str], order_col: str, out_col: str = "n",
                       chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``row_number() OVER (PARTITION BY group_cols ORDER BY order_col)``.

    ``order_col`` must be a non-null integer, unique inside a group.
    """
    chunked = with_chunk(df, order_col, chunk)
    return number_in_chunks(chunked, chunk_offsets(chunked, group_cols), group_cols, order_col, out_col)
