"""Near-duplicate groups by b-bit MinHash.

1. Each document's distinct word shingles give ``perms`` minima.  Groups of
   ``rows`` minima hash to one band key; the low ``BITS`` bits of all minima
   are packed into 64-bit words.
2. Equal sets become one node (smallest doc_id as its label), so groups of
   copies never meet as pairs.
3. Band candidates: every member of a bucket meets the bucket's smallest node.
   The packed signatures estimate the similarity, corrected for chance
   agreement of the low bits; a member's most similar candidates are confirmed on
   the full sets.  Confirmed links give components (large-star / small-star).
4. Buckets whose members are still in several components are compared in blocks of a
   bounded number of members and shingles, across components only, each pair in the first bucket
   that it shares.  Sizes and bit counts decide which members of a block have a
   candidate at all; only these get their full sets, once a block.  There a union-find,
   started from the components so far, compares members of different components on
   their full sets and gives the links that join two of them, at most one less than members.
   So no bucket is capped, no pair is emitted that isn't such a link, and no link between components is left out.

A pair at the threshold is missed by all bands with the probability
``(1 - t ** rows) ** bands`` (6e-9 at t = 0.85, 5e-9 at t = 0.8 with the
parameters here); the estimate's margin is 4.5 standard deviations.

Defined results: null and empty texts have no shingles and are linked with
nothing (component_id is their own doc_id); shorter texts than a shingle are
one shingle; repeated rows get equal results; a null doc_id never becomes a
label while the group holds another; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import WordHashes, ids_and_texts, map_batches, schema_of, shingle_hashes, space_words, staged, texts_of, unused

BITS = 2
MASK = 0x5555555555555555  # the low bit of each 2-bit field
#: Members of a block's chunk, and about how many shingles they have together.
BLOCK = 2_000
BLOCK_SHINGLES = 1 << 21
#: Candidates of a member among its buckets' centres that are confirmed.
FIRST = 3
#: Nodes whose texts may be named in a broadcast (8 bytes each); beyond it the lookup is a shuffled join.
LOOKUP_KEYS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Link when ``100 * intersection >= percent * union`` over shingles of ``shingle`` words."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 48
    seed: int = 1

    @property
    def perms(self) -> int:
        return self.rows * self.bands

    @property
    def least_estimate(self) -> float:
        t, c = self.percent / 100, 0.5 ** BITS
        p = c + (1 - c) * t
        return max(0.0, t - 4.5 * math.sqrt(p * (1 - p) / self.perms) / (1 - c))


class Signer:
    """Set of shingle hashes -> band keys and packed low bits of the minima."""

    def __init__(self, rule: Rule):
        rng = np.random.default_rng(rule.seed)
        self.rule = rule
        self.factor = rng.integers(0, 2**32, (rule.perms, 1), np.uint32) | np.uint32(1)
        self.offset = rng.integers(0, 2**32, (rule.perms, 1), np.uint32)
        self.band = rng.integers(0, 2**63, (rule.bands, rule.rows), np.uint64) | np.uint64(1)
        self.buffer = np.empty((rule.perms, 512), np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest value of each permutation, over pieces that fit the CPU's cache."""
        low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        best = None
        for i in range(0, len(low), 512):
            piece = low[i:i + 512]
            out = self.buffer[:, :len(piece)]
            np.multiply(self.factor, piece, out=out)
            out += self.offset
            least = out.min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best

    def sign(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of minima: band keys (int64) and packed signatures (int64 words)."""
        rule, n = self.rule, len(minima)
        wide = minima.astype(np.uint64).reshape(n, rule.bands, rule.rows)
        keys = ((wide + np.uint64(1)) * self.band).sum(axis=2, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(rule.bands, dtype=np.uint64)
        mixed = minima * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(2**BITS - 1)
        fields = np.zeros((n, -(-rule.perms // 32) * 32), np.uint64)
        fields[:, :rule.perms] = mixed
        shifts = (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
        packed = (fields.reshape(n, -1, 32) << shifts).sum(axis=2, dtype=np.uint64)
        return keys.view(np.int64), packed.view(np.int64)


def estimate(differing_fields, perms: int):
    """Similarity from the number of differing low-bit fields, corrected for chance agreement."""
    c = 0.5 ** BITS
    return (1 - differing_fields / perms - c) / (1 - c)


def set_ids(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    d = xxhash.xxh3_128_digest(shingles.tobytes(), seed=seed)
    a, b = np.frombuffer(d, np.int64)
    return int(a), int(b)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n_shingles, node, node_check (null without shingles), bands, sig."""
    def run(batch: pa.RecordBatch) -> dict:
        words, signer = WordHashes(), Signer(rule)
        n, nodes, checks, minima, full = [], [], [], [], []
        for k, text in enumerate(texts_of(batch)):
            s = shingle_hashes(words.array(space_words(text)), rule.shingle)
            n.append(len(s))
            a, b = set_ids(s, rule.seed) if len(s) else (None, None)
            nodes.append(a)
            checks.append(b)
            if len(s):
                full.append(k)
                minima.append(signer.minima(s))
        bands, sigs = [None] * len(n), [None] * len(n)
        if full:
            keys, packed = signer.sign(np.array(minima))
            for k, x, y in zip(full, keys, packed):
                bands[k], sigs[k] = x, y
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": n, "node": nodes, "node_check": checks, "bands": bands, "sig": sigs}

    return map_batches(ids_and_texts(docs, F.xxhash64(F.col("text").cast("string")).alias("text_key")), run,
                       "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, node_check bigint, bands array<bigint>, sig array<bigint>")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """node, shingles (sorted hashes of the full set) of the nodes in ``wanted``."""
    needed = staged(wanted.select("node").distinct().join(nodes.select("node", "text_key"), "node").select("text_key"), "lookup")
    keys = F.broadcast(needed) if needed.count() <= LOOKUP_KEYS else needed
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text")).join(keys, "text_key", "left_semi")

    def sets():
        words, seen = WordHashes(), set()  # copies in one task are sent once

        def run(batch: pa.RecordBatch) -> dict:
            ids, blobs = [], []
            for text in texts_of(batch):
                s = shingle_hashes(words.array(space_words(text)), rule.shingle)
                if len(s) and (node := set_ids(s, rule.seed)[0]) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    ids.append(node)
                    blobs.append(s.tobytes())
            return {"node": ids, "shingles": blobs}

        return run

    return map_batches(texts, sets, "node bigint, shingles binary", per_task=True).dropDuplicates(["node"])


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the rule."""
    full = staged(_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, rule), "sets")
    both = (pairs.select("a", "b").join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))

    def check(batch: pa.RecordBatch) -> dict:
        a, b, sa, sb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "sa", "sb"))
        keep = [k for k in range(len(a)) if _meets(np.frombuffer(sa[k], np.uint64), np.frombuffer(sb[k], np.uint64), rule.percent)]
        return {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

    return staged(map_batches(both, check, "a bigint, b bigint"), "links")


def _meets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), of nodes with an edge.

    Alternating large-star and small-star steps on the edge list, which is
    written once a round.  The minima are joined under a computed key, so both
    sides of the join are shuffled for it and a node with very many edges can be split.
    """
    star = staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "edges")
    before = None
    while True:
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("u", F.col("u").bitwiseXOR(F.lit(0)))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("hi", F.col("hi").bitwiseXOR(F.lit(0)))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        star = staged(small, "edges")
    roots = star.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return staged(star.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots), "roots")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first three columns (bucket, i, j), whole."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)]).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(keys[:, start].tolist())
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """Members of one bucket's chunks i and j, and who may be linked with whom."""

    def __init__(self, table: pa.Table, rule: Rule):
        self.rule, n = rule, len(table)
        self.here, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        self.ids, self.roots, chunk, self.sizes = (table.column(c).to_numpy() for c in ("node", "root", "mine", "n_shingles"))
        self.sig, self.bands = (table.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("sig", "bands"))
        self.sig = self.sig.view(np.uint64)
        self.left, self.right, self.one = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), i == j

    def candidates(self, x: int, groups: np.ndarray) -> np.ndarray:
        """Members of other groups that ``x`` meets first in this bucket, whose size and bit counts allow
        a link; the most similar first."""
        to = self.right[groups[self.right] != groups[x]]
        if self.one:
            to = to[self.ids[to] > self.ids[x]]
        a, b = np.minimum(self.sizes[to], self.sizes[x]), np.maximum(self.sizes[to], self.sizes[x])
        to = to[100 * a >= self.rule.percent * b]
        if not len(to):
            return to
        d = self.sig[to] ^ self.sig[x]
        e = estimate(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(MASK)).sum(axis=1), self.rule.perms)
        near = e >= self.rule.least_estimate
        to, e = to[near], e[near]
        first = self.bands[x][(self.bands[to] == self.bands[x]).argmax(axis=1)] == self.here
        return to[first][np.argsort(-e[first], kind="stable")]

    def active(self) -> np.ndarray:
        """Members with a candidate."""
        out = np.zeros(len(self.ids), bool)
        for x in self.left:
            to = self.candidates(x, self.roots)
            if len(to):
                out[x] = out[to] = True
        return np.flatnonzero(out)

    def links(self, sets: list[bytes]) -> list[tuple[int, int]]:
        """Confirmed links that join two groups; ``sets``: the members' sorted hashes."""
        full = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(s) for s in full])
        _, dense = np.unique(np.concatenate(full), return_inverse=True)
        places = np.split(dense, np.cumsum(sizes)[:-1])
        marked, groups, out = np.zeros(int(dense.max()) + 1, np.int32), self.roots.copy(), []
        for x in self.left:
            to = self.candidates(x, groups)
            if not len(to):
                continue
            marked[places[x]] = 1
            for at in range(0, len(to), 256):
                part = to[at:at + 256]
                part = part[groups[part] != groups[x]]
                if not len(part):
                    continue
                shared = np.add.reduceat(marked[np.concatenate([places[t] for t in part])], np.cumsum([0, *sizes[part[:-1]]]))
                for t in part[100 * shared >= self.rule.percent * (sizes[part] + sizes[x] - shared)]:
                    if groups[t] != groups[x]:
                        out.append((int(self.ids[x]), int(self.ids[t])))
                        groups[groups == groups[t]] = groups[x]
            marked[places[x]] = 0
        return out


def _residual(members: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame | None:
    """Confirmed links (a, b) between components that share a bucket; enough to join all that are linked."""
    placed = staged(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.sum("n_shingles").alias("m")).filter("x != y")
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("m") / BLOCK_SHINGLES), F.col("n")))
    open_ = staged(open_.select("bucket", chunks.cast("int").alias("k")), "open")
    if open_.isEmpty():
        return None
    inside = placed.join(open_, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    # each member goes to the blocks (own chunk, any chunk) of its bucket
    inside = (inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
              .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    inside = inside.join(nodes.select("node", "bands", "sig"), "node").select("bucket", "i", "j", "mine", "node", "root", "n_shingles", "bands", "sig")
    block = ["bucket", "i", "j"]

    def with_candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            some = Block(table, rule).active()
            if len(some):
                yield from table.take(some).combine_chunks().to_batches()

    active = inside.repartition(*block).sortWithinPartitions(*block).mapInArrow(with_candidates, inside.schema)
    active = staged(active, "active")
    if active.isEmpty():
        return None

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            out = Block(table, rule).links(table.column("shingles").to_pylist())
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    full = active.join(staged(_sets(active, nodes, docs, rule), "sets"), "node").select(*active.columns, "shingles")
    links = staged(full.repartition(*block).sortWithinPartitions(*block).mapInArrow(linked, "a bigint, b bigint").distinct(), "residual")
    return None if links.isEmpty() else links


@dataclass
class Groups:
    """signed: rows of ``signatures``; nodes: one row per distinct set, with its root node;
    links: confirmed pairs of nodes, enough to join all that belong together."""

    signed: DataFrame
    nodes: DataFrame
    links: DataFrame | None


def group(docs: DataFrame, rule: Rule) -> Groups:
    """Components of the similarity graph over distinct shingle sets."""
    while True:
        signed = staged(signatures(docs, rule), "signed")
        nodes = signed.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("label"), F.min("text_key").alias("text_key"), F.min("node_check").alias("x"), F.max("node_check").alias("y"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        nodes = staged(nodes, "nodes")
        if nodes.filter("x != y").isEmpty():
            break
        rule = Rule(rule.shingle, rule.percent, rule.rows, rule.bands, rule.seed + 1)  # two sets with one 64-bit id: hash anew
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre != last")
    shared = staged(shared.select("bucket", "centre"), "buckets")
    members = staged(banded.join(shared, "bucket").select("bucket", "node", "n_shingles", "centre"), "members")
    sig = nodes.select("node", "sig")
    near = (members.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
            .join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(MASK)))),
                         F.lit(0), lambda s, x: s + x)
    near = near.select("a", "b", estimate(differ, rule.perms).alias("e")).filter(F.col("e") >= rule.least_estimate)
    # at most ``bands`` candidates of a member are in its list
    best = near.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("e", "a")), asc=False), 1, FIRST).alias("top"))
    best = staged(best.select(F.explode("top.a").alias("a"), "b"), "best")
    links, roots = None, nodes.select("node", F.col("node").alias("root")).limit(0)
    if not best.isEmpty():
        links = _confirm(best, nodes, docs, rule)
        roots = connected(links)
    if not members.isEmpty():
        more = _residual(members, nodes, roots, docs, rule)
        if more is not None:
            links = more if links is None else staged(links.unionByName(more).distinct(), "links")
            roots = connected(links)
    plain = nodes.select("node", "label", "text_key")
    if links is None:
        return Groups(signed, plain.withColumn("root", F.col("node")), None)
    return Groups(signed, plain.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), links)


def components(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    g = group(docs, rule)
    nodes = staged(g.nodes, "rooted")
    label = staged(nodes.groupBy("root").agg(F.min("label").alias("component_id")), "labels")
    where = staged(nodes.join(label, "root").select("node", "component_id"), "where")
    rows = g.signed.select("doc_id", "n_shingles", "node").join(where, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest (doc_id, hash of its
    text), null ids last; all rows without words stay.  All columns are kept."""
    g = group(docs, rule)
    nodes = staged(g.nodes, "rooted")
    member = g.signed.filter("node is not null").select("doc_id", "text_key", "node").join(nodes.select("node", "root"), "node")
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("f"))
    keep = staged(first.select(F.col("f.doc_id").alias("_keep_id"), F.col("f.text_key").alias("_keep_key")), "keep")
    key, number = unused(docs, "text_key"), unused(docs, "id_number")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(number, F.col("doc_id").cast("bigint"))
    keep = keep.toDF(keep_id := unused(keyed, "keep_id"), keep_key := unused(keyed, "keep_key"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.filter(has_words).join(keep, F.col(number).eqNullSafe(F.col(keep_id)) & (F.col(key) == F.col(keep_key)), "left_semi")
    if not member.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():  # rows repeated as they are
        kept = kept.dropDuplicates([number, key])
    return kept.select(*docs.columns).unionByName(keyed.filter(~has_words).select(*docs.columns))
