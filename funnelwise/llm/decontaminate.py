"""Benchmark decontamination with suffix arrays over the training text.

The documents are cut into shards of a bounded number of words.  Each shard
gets a word-level suffix array (prefix doubling).  The suffixes of all test items are
sorted, too, so that those with equal windows stand together; each distinct window
is looked up once by binary search, which yields the run of training
suffixes that begin with it, and with it all locations.  A location is then looked up
among the sorted item suffixes of its window: the longest verbatim match is with a
neighbour of its place there.  So a prompt that many items share and many
documents hold costs locations plus items, not their product.

Words that no test item uses can't be part of a match: they act as
separators, and stretches between them that are shorter than the shortest
window hold no match and are left out of the array.  Nothing else is dropped.

Test items go to the tasks in blocks of a bounded number of bytes; a larger
benchmark takes more passes over the documents, whose results are merged.

Defined results: null and empty texts have no words; an item without words
matches nothing; items with a null id mark words as hit but aren't listed;
repeated document rows are judged one by one; repeated item ids count once;
further columns of either table are ignored (``decontaminate`` keeps those of
the documents); an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import alnum_words, ids_and_texts, schema_of, staged, texts_of, unused

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8_000_000

_STATE = [("n_words", "bigint"), ("n_hit", "bigint"), ("hit_bits", "binary"), ("item_ids", "array<string>"), ("longest_words", "int"),
          ("longest_item", "string"), ("longest_at", "int")]


class Items:
    """Test items as numbered words, and all their suffixes that hold a window."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        coded = [(i, [number.setdefault(w, len(number) + 1) for w in words]) for i, words in rows if words]
        self.ids = [i for i, _ in coded]
        lengths = [len(c) for _, c in coded]
        self.depth = max(lengths, default=0)
        self.words = np.zeros(sum(lengths) + self.depth + len(coded) + 1, np.int32)
        starts, owner, windows, at = [], [], [], 0
        for k, (_, codes) in enumerate(coded):
            self.words[at:at + len(codes)] = codes
            size = min(window, len(codes))
            for j in range(len(codes) - size + 1):
                starts.append(at + j)
                owner.append(k)
                windows.append(size)
            at += len(codes) + 1  # a zero ends each item
        starts, owner, windows = (np.array(x, np.int64) for x in (starts, owner, windows))
        self.shortest = int(windows.min()) if len(windows) else 0
        self.widest = int(windows.max()) if len(windows) else 0
        # suffixes by window size, then in order of their words: equal windows are neighbours
        rank = np.empty(len(self.words), np.int64)
        rank[suffix_array(self.words, self.depth)] = np.arange(len(self.words))
        order = np.lexsort((rank[starts], windows))
        self.starts, self.owner, sizes = starts[order], owner[order], windows[order]
        new = np.ones(len(order), bool)
        new[1:] = sizes[1:] != sizes[:-1]
        for j in range(self.widest):
            new[1:] |= (sizes[1:] > j) & (self.words[self.starts[1:] + j] != self.words[self.starts[:-1] + j])
        #: Of each distinct window: its suffixes (a run of ``starts``), its size, and the items that hold it.
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(order))
        self.windows = sizes[self.begin]
        names = sorted({i for i in self.ids if i is not None})
        place = {n: k for k, n in enumerate(names)}
        named = np.array([place.get(i, -1) for i in self.ids], np.int64)[self.owner] if len(order) else np.empty(0, np.int64)
        self.names = np.array(names, object)  # item ids in order; ``holders`` are places in it
        self.holders = [np.unique(named[x:y][named[x:y] >= 0]) for x, y in zip(self.begin, self.end)]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` words that begin there (prefix doubling)."""
    rank, k = words.astype(np.int64) + 1, 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:max(len(rank) - k, 0)] = rank[k:]
        key = rank * (rank.max() + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        dense = 1 + np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = dense
        k *= 2
        if k >= depth or dense[-1] == len(words):
            return order


def search(words: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window the range of training suffixes that begin with it
    (``words`` must be followed by ``items.widest`` zeros)."""
    bounds = []
    for upper in (False, True):
        first = items.starts[items.begin]
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            at, q, size = order[mid], first[open_], items.windows[open_]
            sign = np.zeros(len(open_), np.int8)  # of training suffix - item suffix
            left = np.arange(len(open_))
            for j in range(items.widest):
                left = left[size[left] > j]
                diff = np.sign(words[at[left] + j] - items.words[q[left] + j])
                sign[left] = diff
                left = left[diff == 0]
                if not len(left):
                    break
            below = sign <= 0 if upper else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        bounds.append(lo)
    return bounds[0], bounds[1]


def _common(words: np.ndarray, at: np.ndarray, items: Items, suffix: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many words training positions and item suffixes share, of which ``least`` are known."""
    length = least.copy()
    grow = np.arange(len(at))
    while len(grow):
        w = words[at[grow] + length[grow]]
        grow = grow[(w != 0) & (w == items.words[items.starts[suffix[grow]] + length[grow]])]
        length[grow] += 1
    return length


def _longest(words: np.ndarray, at: np.ndarray, window: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Of each location of a window: the longest verbatim match and an item suffix that has it."""
    least = items.windows[window]
    lo, hi = items.begin[window].copy(), items.end[window].copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        shared = _common(words, at[open_], items, mid, least[open_])
        below = items.words[items.starts[mid] + shared] < words[at[open_] + shared]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    before, after = np.maximum(lo - 1, items.begin[window]), np.minimum(lo, items.end[window] - 1)
    x, y = _common(words, at, items, before, least), _common(words, at, items, after, least)
    return np.maximum(x, y), np.where(x >= y, before, after)


def match_shard(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All locations of windows in a shard's words (zeros separate): position, window, longest match, its item suffix."""
    none = np.empty(0, np.int64)
    known = np.concatenate([[0], (codes != 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(known))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= items.shortest
    begin, end = begin[long], end[long]
    if not len(begin) or not len(items.starts):
        return none, none, none, none
    size = end - begin
    out = np.cumsum(size + 1) - (size + 1)  # a zero after each run
    place = np.full(int((size + 1).sum()), -1, np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place[np.repeat(out, size) + within] = np.repeat(begin, size) + within
    words = np.where(place >= 0, codes[place], 0).astype(np.int32)
    order = suffix_array(words, items.depth)
    words = np.concatenate([words, np.zeros(items.depth + 1, np.int32)])
    lo, hi = search(words, order, items)
    many = hi - lo
    window = np.repeat(np.arange(len(lo)), many)
    at = order[np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    length, suffix = _longest(words, at, window, items)
    return place[at], window, length, suffix


def _judge(shard: list[list[int]], items: Items, before: list[tuple | None]) -> list[tuple]:
    """State of each document of a shard after this block of items."""
    sizes = np.array([len(d) for d in shard], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    codes = np.zeros(int((sizes + 1).sum()), np.int32)
    for d, f in zip(shard, first):
        codes[f:f + len(d)] = d
    at, window, length, suffix = match_shard(codes, items)
    cover = np.zeros(len(codes) + 1, np.int64)
    if len(at):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + items.windows[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(first, at, "right") - 1
    by_doc = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[by_doc], np.arange(len(shard) + 1))
    out, listed = [], {}  # item ids of a set of windows, which many documents may hold
    for k, size in enumerate(sizes):
        old = before[k]
        mine = by_doc[cut[k]:cut[k + 1]]
        if not len(mine):
            out.append(old or (int(size), 0, None, [], 0, None, None))
            continue
        bits = hit[first[k]:first[k] + size]
        held = np.unique(window[mine])
        if (key := held.tobytes()) not in listed:
            listed[key] = items.names[np.unique(np.concatenate([items.holders[w] for w in held]))].tolist()
        found = listed[key]
        best = mine[np.lexsort((at[mine], -length[mine]))[0]]
        longest = (int(length[best]), items.ids[items.owner[suffix[best]]], int(at[best] - first[k]))
        if old and old[2] is not None:
            bits = bits | np.unpackbits(np.frombuffer(old[2], np.uint8), count=int(size)).astype(bool)
            found = sorted(set(found).union(old[3]))
            longest = max(longest, old[4:], key=lambda x: x[0])
        out.append((int(size), int(bits.sum()), np.packbits(bits).tobytes(), found, *longest))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    rows, size = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        raw = (text or "").encode()
        if rows and size + len(raw) > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((item, alnum_words(raw)))
        size += len(raw)
    if rows:
        yield rows


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and seven last columns with the match state of each row: words, words hit,
    bit set of hit words, matched item ids, and the longest verbatim match (length, item, word)."""
    spark = docs.sparkSession
    state = [(unused(docs, n), k) for n, k in _STATE]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {k}" for n, k in state])
    arrow = schema_of(spark, ddl)
    blocks = _blocks(benchmark, block_bytes)
    df, rows, again = docs, next(blocks, []), False
    while True:
        held = spark.sparkContext.broadcast(rows)  # at most block_bytes of text, or one item
        df = df.mapInArrow(_pass(held, window, shard_words, docs.columns, [n for n, _ in state], arrow, again), ddl)
        rows, again = next(blocks, None), True
        if rows is None:
            return df
        df = staged(df, "decontaminate")


def _pass(held, window: int, shard_words: int, names: list[str], added: list[str], arrow: pa.Schema, again: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value, window)
        number = items.vocabulary.get
        for batch in batches:
            shard, before, start, size = [], [], 0, 0
            texts = texts_of(batch)
            old = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in added))) if again else [None] * len(texts)
            for k, text in enumerate(texts):
                shard.append([number(w, 0) for w in alnum_words(text)])
                before.append(old[k])
                size += len(shard[-1])
                if size >= shard_words or k + 1 == len(texts):
                    state = list(zip(*_judge(shard, items, before)))
                    part = batch.slice(start, k + 1 - start)
                    columns = [part.column(part.schema.get_field_index(c)) for c in names]
                    columns += [pa.array(s, type=arrow.field(c).type) for c, s in zip(added, state)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)
                    shard, before, start, size = [], [], k + 1, 0

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids, and the longest verbatim
    match (longest_words, longest_item, longest_at: first word, from 0)."""
    return scan(ids_and_texts(docs), benchmark, window, **sizes).drop("text", "hit_bits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """``docs`` without the rows that hold a window of a test item; all columns kept."""
    return scan(docs, benchmark, window, **sizes).filter(F.col(unused(docs, "n_hit")) == 0).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    leaks = find_leaks(docs, benchmark, window)
    ids = F.array_sort(F.array_distinct("item_ids"))
    return leaks.select("doc_id", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
