"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its number of words and one end mark.  Documents longer
than the largest capacity are cut into pieces of that capacity and a rest.
Pieces are taken from the longest to the shortest; each goes to the open bin
with the least room that still holds it, of several to the one filled last (best
fit).  If none does, a bin is
opened in the capacity that the mix names for pieces of that class (class: the
smallest capacity that holds the piece).  At the end each bin is downsized to
the smallest permitted capacity that holds its contents.

The mix is chosen for the permitted lengths together, for each shard: all mixes
of opening sizes are packed and the one with the least total cost after
downsizing stays, where a bin's cost is a fixed part, a linear and a quadratic
one.  The single sizes are among them, so none of them would have cost less.
(n capacities have n! mixes: meant for a handful.)

Ids and lengths are written to the checkpoint folder and dealt by a hash of
their position in that stored table, which a retried task finds again, into
shards of about ``SHARD_ROWS`` rows, packed independently of one another: a
shard fits a task whatever the ids or texts, and texts aren't shuffled.

Defined results: null and empty texts are one end mark; repeated rows are
packed each for itself; null ids are kept as null; other columns are ignored;
an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import staged

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
FIXED_COST = 64.0
QUADRATIC_COST = 1 / 16_384


def cost(capacity: int) -> float:
    """Relative cost of computing a sequence of that length."""
    return FIXED_COST + capacity + QUADRATIC_COST * capacity * capacity


def mixes(capacities: Sequence[int]) -> list[tuple[int, ...]]:
    """For each class of pieces (ascending) the capacity that its bins open with: every choice."""
    capacities = sorted(capacities)
    return list(product(*(capacities[k:] for k in range(len(capacities)))))


def best_fit(lengths: Sequence[int], capacities: Sequence[int], mix: Sequence[int]) -> tuple[list[int], list[int]]:
    """Bin number of each piece and content of each bin; ``lengths`` from the longest to the shortest."""
    most = max(capacities)
    opening = [mix[bisect_left(capacities, n)] for n in range(most + 1)]  # length -> capacity to open
    by_room: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by their room
    open_rooms = 0  # bit r is set while by_room[r] has bins
    where, content = [], []
    for size in lengths:
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
            content[b] += size
        else:
            b, r = len(content), opening[size]
            content.append(size)
        where.append(b)
        if r > size:
            by_room[r - size].append(b)
            open_rooms |= 1 << r - size
    return where, content


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin number of each piece, final capacity and content of each bin, by the cheapest mix
    (of equally cheap ones the first).

    ``lengths`` must be at least 1 and at most the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [lengths[i] for i in order]
    costs = [cost(c) for c in capacities]
    best = None
    for mix in mixes(capacities):
        where, content = best_fit(falling, capacities, mix)
        total = sum(costs[bisect_left(capacities, n)] for n in content)
        if best is None or total < best[0]:
            best = total, where, content
    _, found, content = best
    bins = [0] * len(lengths)
    for i, b in zip(order, found):
        bins[i] = b
    return bins, [capacities[bisect_left(capacities, n)] for n in content], content


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: shard, bin, capacity, used (words in the bin), start (in the bin),
    doc_id, piece, first_word (in the document), length."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    stored = staged(docs.select(known.alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), (words + 1).cast("bigint").alias("length")), "lengths")
    shards = max(1, -(-stored.count() // shard_rows))
    rows = stored.withColumn("position", F.monotonically_increasing_id())
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("position"), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "position"], ascending=[False, True, True])
        owner, piece, lengths = [], [], []
        for row, n in enumerate(group["length"].tolist()):
            for k in range(-(-n // most)):
                owner.append(row)
                piece.append(k)
                lengths.append(min(most, n - k * most))
        where, capacity, content = pack(lengths, capacities)
        fill, start = [0] * len(capacity), []
        for b, n in zip(where, lengths):
            start.append(fill[b])
            fill[b] += n
        return pd.DataFrame({"shard": int(group["shard"].iloc[0]), "bin": where, "capacity": [capacity[b] for b in where], "used": [content[b] for b in where],
                             "start": start, "doc_id": group["doc_id"].astype("Int64").mask(group["unnamed"]).iloc[owner].array, "piece": piece,
                             "first_word": [k * most for k in piece], "length": lengths})

    return rows.groupBy("shard").applyInPandas(run, "shard int, bin int, capacity int, used int, start int, doc_id bigint, piece int, first_word bigint, length int")
