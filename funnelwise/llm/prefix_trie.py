"""Conversation prefix trie by vertical bitmaps.

A node is a distinct sequence of first ``d`` turns (role, text); its members are
the conversations that start with it.

1. Turns are hashed where they are read (128 bits; words are counted there, too),
   so no text is shuffled.  They are range-partitioned by (conversation, turn),
   numbered inside each partition and shifted by the conversation's rows before it.
2. Conversations are sorted into shards of at most ``UNITS`` conversations or
   ``ROWS`` turns.  A shard's index maps (position, turn) to the bitset of its
   conversations.  Depth first, a node's bitset is intersected with the posting of
   its lowest remaining member's next turn: that is a child, its members are
   taken off, and so on.  Popcounts, smallest members and the lists of those that
   end there come from the bitsets.
3. A node's name is a polynomial hash of its turns, so nodes of several shards meet
   by name: members add up, the smallest member is the minimum, and the end lists,
   sorted inside each shard as shards are ranges of ids, are hashed one after another.
4. Sums over subtrees: each node's gain is held by its smallest member, which is in
   one shard.  Each shard adds its own gains up from children to parents, and the shards'
   sums add up by name.  So no step goes level by level.

A conversation longer than ``SEGMENT`` turns is cut into pieces that are spread
like any other rows; the name that a piece starts from is composed from the pieces
before it, and gains of later pieces are handed to where the earlier piece stops.

Defined results: null role or text is empty; null ``turn`` comes first, equal turn
numbers are ordered by the hash of their turn, repeated rows are turns of their own;
rows without a conv_id belong to no conversation; an empty table has no
conversation and no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from funnelwise.functions.sequence import CHUNK, chunk_offsets, number_in_chunks
from funnelwise.llm.common import schema_of, staged

UNITS = 4_096
ROWS = 65_536
SEGMENT = 16_384
WORD = r"[^\x20\x09-\x0D]+"
#: Modulus and base of node names.
PRIME = 2**127 - 1
BASE = 0x5DEECE66D1234567F0F1E2D3C4B5A697
ROOT = 1

_LOCAL_DDL = ("shard_conv bigint, shard_segment bigint, k int, parent_k int, unit_conv bigint, unit_segment bigint, node binary, parent binary, "
              "depth bigint, n bigint, conv_id bigint, words bigint, ends_first bigint, ends binary")


def _is_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (position from 1), t1, t2 (hash of the turn), words: one row per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), _is_word_count(text).alias("words")).filter(F.col("conv_id").isNotNull())
    dealt = staged(rows.repartitionByRange("conv_id", "turn", "t1").withColumn(CHUNK, F.spark_partition_id().cast("long")), "dealt")
    return number_in_chunks(dealt, chunk_offsets(dealt, ["conv_id"]), ["conv_id"], ["turn", "t1", "t2"])


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, n_turns), (conv_id, pos, t1, t2, words)."""
    turns = staged(hashed_turns(conversations), "numbered")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return staged(sizes, "sizes"), turns.select("conv_id", F.col("n").alias("pos"), "t1", "t2", "words")


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c takes its first h turns from conversation c - c % family, h = crc32(c) % most,
    then its own turns after its first h.  (conv_id, n_turns), (conv_id, pos, t1, t2, words)."""
    turns = staged(hashed_turns(conversations), "numbered")
    c = F.col("conv_id")
    own = staged(turns.groupBy("conv_id").agg(F.count("*").alias("n_own")), "own")
    head = F.crc32(c.cast("string").cast("binary")) % F.lit(most)
    convs = own.select("conv_id", "n_own", head.alias("h"), (c - c % F.lit(family)).alias("base"))
    bases = own.filter(c % F.lit(family) == 0).select(c.alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    sizes = staged(convs.select("conv_id", "base", "h", "n_head", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "sizes")
    tails = turns.join(sizes.select("conv_id", "h", "n_head"), "conv_id").filter("n > h").select(
        "conv_id", (F.col("n_head") + F.col("n") - F.col("h")).alias("pos"), "t1", "t2", "words")
    first = turns.filter((F.col("n") < most) & (c % F.lit(family) == 0)).select(c.alias("base"), F.col("n").alias("pos"), "t1", "t2", "words")
    heads = sizes.select("conv_id", "base", "h").join(first, "base").filter("pos <= h").select("conv_id", "pos", "t1", "t2", "words")
    return sizes.select("conv_id", "n_turns"), heads.unionByName(tails)


def _turn(t1: int, t2: int) -> int:
    return ((t1 & (2**64 - 1)) << 64) | (t2 & (2**64 - 1))


def _step(name: int, turn: int) -> int:
    return (name * BASE + turn + 1) % PRIME


def _starts(turns: DataFrame) -> DataFrame:
    """conv_id, segment, start: the name of what comes before each further piece of a long conversation."""
    long = turns.filter("segment > 0").select("conv_id").distinct()
    pieces = turns.filter("pos > 0").join(long, "conv_id", "left_semi")

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        name = 0
        for a, b in zip(table.column("t1").to_pylist(), table.column("t2").to_pylist()):
            name = _step(name, _turn(a, b))
        return pa.table({"conv_id": table.column("conv_id")[:1], "segment": table.column("segment")[:1], "size": pa.array([len(table)], pa.int64()),
                         "name": pa.array([name.to_bytes(16, "big")], pa.binary())})

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        name, out = ROOT, []
        for size, piece in zip(table.column("size").to_pylist(), table.column("name").to_pylist()):
            out.append(name.to_bytes(16, "big"))
            name = (name * pow(BASE, size, PRIME) + int.from_bytes(piece, "big")) % PRIME
        return pa.table({"conv_id": table.column("conv_id"), "segment": table.column("segment"), "start": pa.array(out, pa.binary())})

    folded = pieces.groupBy("conv_id", "segment").applyInArrow(fold, "conv_id bigint, segment bigint, size bigint, name binary")
    return folded.groupBy("conv_id").applyInArrow(compose, "conv_id bigint, segment bigint, start binary").filter("segment > 0")


class Shard:
    """Pieces of conversations in order of (conv_id, segment), and their bitmap index."""

    def __init__(self):
        self.units: list[tuple[int, int, int, bytes | None]] = []  # conv_id, segment, length of the conversation, start
        self.first: list[int] = []  # position of the unit's first row
        self.turns: list[list[int]] = []
        self.words: list[list[int]] = []
        self.postings: dict[tuple[int, int], int] = {}
        self.rows = 0

    def add(self, conv_id, segment, n_turns, start, pos, turn, words) -> None:
        if not self.units or self.units[-1][:2] != (conv_id, segment):
            self.units.append((conv_id, segment, n_turns, start))
            self.first.append(pos)
            self.turns.append([])
            self.words.append([])
        key = (pos, turn)
        self.postings[key] = self.postings.get(key, 0) | 1 << len(self.units) - 1
        self.turns[-1].append(turn)
        self.words[-1].append(words)
        self.rows += 1

    def full(self) -> bool:
        return len(self.units) >= UNITS or self.rows >= ROWS

    def children(self, members: int, pos: int) -> Iterator[tuple[int, int]]:
        """(members of a child, its lowest unit) of the node of ``members`` before position ``pos``."""
        while members:
            unit = (members & -members).bit_length() - 1
            at = pos - self.first[unit]
            if at >= len(self.turns[unit]):
                members &= members - 1
                continue
            child = members & self.postings[pos, self.turns[unit][at]]
            members &= ~child
            yield child, unit

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_LOCAL_DDL`` in depth-first order; rows without a node tell where a
        piece goes on in the next one."""
        shard = self.units[0][:2]
        groups: dict[tuple[int, bytes | None], int] = {}
        for i, (_, segment, _, start) in enumerate(self.units):
            groups[segment, start] = groups.get((segment, start), 0) | 1 << i
        stack = []
        for (segment, start), members in groups.items():
            before = int.from_bytes(start, "big") if start else None
            stack += [(child, unit, segment * SEGMENT, before, -1) for child, unit in self.children(members, segment * SEGMENT)]
        k = 0
        while stack:
            members, unit, pos, parent, parent_k = stack.pop()
            at = pos - self.first[unit]
            name = ROOT if parent is None else _step(parent, self.turns[unit][at])
            ends, goes_on = [], []
            rest = members
            while rest:
                low = rest & -rest
                i = low.bit_length() - 1
                if pos - self.first[i] + 1 == len(self.turns[i]):
                    (ends if self.units[i][2] == pos else goes_on).append(i)
                rest ^= low
            ids = [self.units[i][0] for i in ends]
            yield (*shard, k, parent_k, None, None, name.to_bytes(16, "big"), None if parent is None else parent.to_bytes(16, "big"), pos,
                   members.bit_count(), self.units[unit][0], self.words[unit][at], ids[0] if ids else None, ",".join(map(str, ids)).encode() if ids else None)
            for j, i in enumerate(goes_on):
                yield (*shard, k + 1 + j, k, self.units[i][0], self.units[i][1] + 1, *[None] * 8)
            here, k = k, k + 1 + len(goes_on)
            stack += [(child, first, pos + 1, name, here) for child, first in self.children(members, pos + 1)]


def _local_nodes(rows: DataFrame) -> DataFrame:
    schema = schema_of(rows.sparkSession, _LOCAL_DDL)

    def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
        out = []
        for row in shard.nodes():
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for conv_id, segment, pos, t1, t2, words, n_turns, start in zip(*(c.to_pylist() for c in batch.columns)):
                if shard.full() and shard.units[-1][:2] != (conv_id, segment):
                    yield from emit(shard)
                    shard = Shard()
                shard.add(conv_id, segment, n_turns, start, pos, _turn(t1, t2), words)
        if shard.units:
            yield from emit(shard)

    ordered = rows.select("conv_id", "segment", "pos", "t1", "t2", "words", "n_turns", "start")
    return ordered.repartitionByRange("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "pos").mapInArrow(run, _LOCAL_DDL)


def _end_hashes(local: DataFrame) -> DataFrame:
    """node, ends_sha256 of nodes where conversations end: the shards' lists in order, never joined in memory."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            names, hashes = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        names.append(node)
                        hashes.append(digest.hexdigest())
                    node, digest = name, hashlib.sha256()
                digest.update(text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    lists = local.filter("ends is not null").select("node", "ends", "ends_first").repartition("node").sortWithinPartitions("node", "ends_first")
    return lists.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def _subtree_sums(local: DataFrame, gains: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens; ``gains``: node, conv_id (its smallest member), depth, leaf, gain."""
    piece = F.floor(F.col("depth") / F.lit(SEGMENT)).cast("bigint")
    later = (gains.select(F.col("conv_id").alias("unit_conv"), piece.alias("unit_segment"), "leaf", "gain").filter("unit_segment > 0")
             .unionByName(local.filter("node is null").select("unit_conv", "unit_segment", F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("gain")))
             .groupBy("unit_conv", "unit_segment").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain")))  # a row per piece of a long conversation
    after = Window.partitionBy("unit_conv").orderBy(F.col("unit_segment").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = later.select("unit_conv", "unit_segment", F.sum("leaf").over(after).alias("leaf"), F.sum("gain").over(after).alias("gain"))
    place = ["shard_conv", "shard_segment", "k", "parent_k", "node"]
    here = local.filter("node is not null").select(*place, "conv_id").join(
        gains.select("node", F.col("conv_id").alias("owner"), "leaf", "gain"), "node")
    mine = F.col("conv_id") == F.col("owner")
    here = here.select(*place, F.when(mine, F.col("leaf")).otherwise(F.lit(0)).alias("leaf"), F.when(mine, F.col("gain")).otherwise(F.lit(0)).alias("gain"))
    onward = local.filter("node is null").select(*place, "unit_conv", "unit_segment").join(later, ["unit_conv", "unit_segment"])
    rows = here.unionByName(onward.select(*here.columns))

    def add_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        parents, leaf, gain, nodes = (table.column(c).to_pylist() for c in ("parent_k", "leaf", "gain", "node"))
        for k in range(len(parents) - 1, -1, -1):  # children come after their parents
            if parents[k] >= 0:
                leaf[parents[k]] += leaf[k]
                gain[parents[k]] += gain[k]
        named = [k for k, n in enumerate(nodes) if n is not None]
        return pa.table({"node": pa.array([nodes[k] for k in named], pa.binary()), "n_leaves": pa.array([leaf[k] for k in named], pa.int64()),
                         "saved_tokens": pa.array([gain[k] for k in named], pa.int64())})

    sums = rows.groupBy("shard_conv", "shard_segment").applyInArrow(add_up, "node binary, n_leaves bigint, saved_tokens bigint")
    return sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def trie(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: node, parent (names), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``sizes``: (conv_id, n_turns) of every conversation, those without turns, too;
    ``turns``: (conv_id, pos, t1, t2, words), positions from 1.
    """
    zero = F.lit(0).cast("bigint")
    rows = turns.unionByName(sizes.select("conv_id", zero.alias("pos"), zero.alias("t1"), zero.alias("t2"), zero.alias("words")))
    rows = rows.withColumn("segment", F.floor(F.col("pos") / F.lit(SEGMENT)).cast("bigint"))
    rows = staged(rows.join(sizes, "conv_id"), "turns")
    rows = staged(rows.join(staged(_starts(rows), "starts"), ["conv_id", "segment"], "left"), "pieces")
    local = staged(_local_nodes(rows), "local")
    nodes = staged(local.filter("node is not null").groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted")
    gains = nodes.select("node", "conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = (nodes.join(staged(_subtree_sums(local, gains), "sums"), "node").join(staged(_end_hashes(local), "ends"), "node", "left")
            .join(parents, "parent", "left"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return full.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The contract's rows: the trie of the rebuilt conversations, without node names."""
    return trie(*rebuilt(conversations)).drop("node", "parent")
