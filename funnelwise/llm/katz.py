"""Katz backoff language model: counts, normalised weights, scores.

Tokens are words and one end mark per text.  Orders are two: a token's
probability comes from its pair with the token before, else from the token
alone.  Counts up to ``CUT`` are discounted by Good-Turing estimates.

* P(w | h) = d(c) c / (c(h) + 1) for a pair seen c times,
  alpha(h) P(w) for an unseen one, where alpha(h) is what the seen pairs leave,
  divided by what their second tokens leave of the single-token distribution,
  so the probabilities of each context add up to one exactly.
* P(w) = d(c) c / (N + 1) for a token seen c times; what is left goes to the
  one event "unknown token".

The added one in each total keeps some mass for unseen events where no count
is discounted.  Every token is a context (history) of its own, as is the beginning
of a text; after a token that training texts don't hold, P(w | h) = P(w).  Figures
of the ``CONTEXTS`` commonest are broadcast, those of all others ("rare") lie in
tables partitioned by history.  With ``contexts``, rarer tokens form one class instead.

How it runs (the tables are partitioned by key; nothing grows on the driver):

1. Single-token counts over all training texts, summed by token and written as
   a table; the commonest tokens and the counts of counts are read from it.
2. Pairs of the ``DENSE`` commonest tokens (and contexts), which may hold large
   shares of all pairs, are counted in each task and summed.
3. Each task numbers the documents of a batch, adds up what their common pairs give, and
   sends its remaining distinct pairs, counted, to key buckets: rare second tokens by
   token, common ones by pair, common tokens after a rare history by history.  A pair
   that a third of all documents repeat is one row a batch, not one an occurrence.
   A bucket sums the counts of its pairs (and rare tokens) in training texts and
   answers each batch once per pair; which documents hold a pair
   stays with the batch.  The bucket also adds up what the contexts' seen pairs hold, and sends
   the seen pairs of rare histories that held-out texts hold to the history's bucket.
4. Batches add up the answers per document, and Spark the contexts' sums per context; with the common contexts' weights,
   a table of fixed size, each document's score follows but for unseen pairs
   of rare histories: their weights are asked for by history and added last.
   As every rare token of a document is followed by one token there, c(h) + 1 of all
   its rare histories comes from the counts of its rare tokens.

Defined results: null and empty texts are the end mark alone; null ids count
as learned from; repeated rows each count and get a row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import Shipped, crc_mod, ids_and_texts, mix64, space_words, staged, texts_of

CUT = 5
CONTEXTS = 65_534
DENSE = 1_022
BATCH_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
FLUSH_TOKENS = 2_000_000
MASK = (1 << 62) - 1
HISTORIES = -1 << 40  # targets from here down are buckets of rare histories
END = -1  # the end mark's code before codes are ranks; no word hash is negative


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 3) >> 2


def discounts(of_counts: dict[int, int], cut: int = CUT) -> np.ndarray:
    """Katz's factor for counts 0..cut (index 0 unused): Good-Turing for counts up to ``cut``,
    in (0, 1]; 1 where the counts of counts give no valid estimate."""
    n = [of_counts.get(r, 0) for r in range(cut + 2)]
    out = np.ones(cut + 1)
    if not n[1]:
        return out
    tail = (cut + 1) * n[cut + 1] / n[1]
    for r in range(1, cut + 1):
        if n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            if 0 < d <= 1:
                out[r] = d
    return out


class Codes(dict):
    """word -> rank among the common tokens, else its hash with bit 62 set."""

    def __init__(self, common: np.ndarray):
        super().__init__()
        self.order = np.argsort(common, kind="stable")
        self.sorted = common[self.order]

    def rank(self, code: int) -> int | None:
        i = int(np.searchsorted(self.sorted, code))
        return int(self.order[i]) if i < len(self.sorted) and self.sorted[i] == code else None

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        code = word_code(word)
        r = self.rank(code)
        self[word] = value = r if r is not None else code | 1 << 62
        return value


def single_counts(train: DataFrame) -> DataFrame:
    """(token, n) over all training texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([END if w is None else word_code(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())],
                                             names=["token", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in texts_of(batch):
                words = space_words(text)
                found.update(words)
                found[None] += 1
                size += len(words)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    size = 0
        if found:
            yield flush()

    return train.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Common:
    """The commonest tokens in order, their counts, and global figures (bounded size)."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int, texts: int, of_counts: dict[int, int], lumped: bool):
        self.lumped = lumped
        self.tokens, self.counts, self.total, self.distinct = tokens, counts, total, distinct
        self.discount = discounts(of_counts)
        r = np.arange(1, CUT + 1)
        lost = sum((1 - self.discount[k]) * k * of_counts.get(k, 0) for k in r)
        self.log_unknown = float(np.log10((lost + 1) / (total + 1)))
        end = np.flatnonzero(tokens == END)
        self.end = int(end[0]) if len(end) else -1
        # contexts: ranks, then the beginning, then the class of all others (or the mark of a rare history)
        self.begin, self.other = len(tokens), len(tokens) + 1
        as_context = counts.astype(float).copy()
        others = total - counts.sum() if lumped else 0
        named = counts[tokens != END]
        #: Rare tokens, and maybe the end mark, are counted less often than this.
        self.floor = 0 if lumped else int(named.min(initial=np.iinfo(np.int64).max))
        self.log_end = float(np.log10(texts + 1)) if texts < self.floor else 0.0
        if self.end >= 0:
            as_context[self.end] = 0  # nothing follows the end
        self.context = np.concatenate([as_context, [texts, others]])
        self.dense = min(DENSE, len(tokens))

    def log_single(self, n: np.ndarray) -> np.ndarray:
        """log10 P(w) of tokens seen ``n`` times."""
        n = np.asarray(n, float)
        factor = np.where(n <= CUT, self.discount[np.minimum(n, CUT).astype(int)], 1.0)
        return np.where(n > 0, np.log10(np.maximum(factor * n, 1e-300) / (self.total + 1)), self.log_unknown)

    def dense_context(self, h: np.ndarray) -> np.ndarray:
        """Row of a context in the dense table, -1 for the ones outside it."""
        return np.where(h < self.dense, h, np.where((h == self.begin) | (self.lumped & (h == self.other)), self.dense + h - self.begin, -1))

    def rare(self, h: np.ndarray) -> np.ndarray:
        """Whether contexts are rare histories, told apart by their codes."""
        return (h == self.other) & (not self.lumped)


class Batcher:
    """Texts of one task in batches of numbered documents, training ones first."""

    def __init__(self, common: Common):
        self.common, self.codes = common, Codes(common.tokens)

    def batches(self, stream: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Document ids (training first), how many of them train, and of each token its
        document, context, code and the code before it."""
        rows, size = [], 0
        for batch in stream:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                words = space_words(text)
                codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
                rows.append((held, doc_id, codes))
                size += len(words) + 1
                if size >= BATCH_TOKENS or len(rows) >= 60_000:
                    yield self._cut(rows)
                    rows, size = [], 0
        if rows:
            yield self._cut(rows)

    def _cut(self, rows):
        rows = sorted(rows, key=lambda r: r[0])  # stable: False before True
        c = self.common
        sizes = np.array([len(r[2]) + 1 for r in rows])
        end = c.end if c.end >= 0 else 1 << 61  # without training texts the end mark is unknown, too
        token = np.full(int(sizes.sum()), end, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for (_, _, codes), a in zip(rows, at):
            token[a:a + len(codes)] = codes
        context = np.empty_like(token)
        context[1:] = np.where(token[:-1] < len(c.tokens), token[:-1], c.other)
        context[at] = c.begin
        return [r[1] for r in rows], sum(not r[0] for r in rows), np.repeat(np.arange(len(rows)), sizes), context, token, np.roll(token, 1)


def parts_of(buckets: int) -> int:
    """In how many groups the buckets' sums of contexts are added up (64 tables of fixed size each, or fewer)."""
    return max(64, buckets // 64)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def dense_pairs(rows: DataFrame, held) -> DataFrame:
    """(pair, n) of the dense table's pairs in training texts."""
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        total = np.zeros((common.dense + 2) * max(1, common.dense), np.int64)
        for _, _, _, context, token, _ in Batcher(common).batches(stream):
            h = common.dense_context(context)
            inside = (h >= 0) & (token < common.dense)
            total += np.bincount(h[inside] * common.dense + token[inside], minlength=len(total))
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(total[pairs], pa.int64())], names=["pair", "n"])

    return rows.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w - (w == 8))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def steps(x: np.ndarray) -> bytes:
    """Non-decreasing integers by their differences."""
    return pack_ints(np.diff(x, prepend=0))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b))


class Tally:
    """What a document needs of its tokens, added up for the documents of a batch."""

    COLUMNS = ["seen", *(f"seen_{r}" for r in range(1, CUT + 1)), "context", "known", "base", "backed", "histories"]

    def __init__(self, docs: int, common: Common):
        self.common, self.sums = common, np.zeros((len(self.COLUMNS), docs))
        self.unseen: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc: np.ndarray, context: np.ndarray, pair: np.ndarray, single: np.ndarray) -> None:
        """Tokens of ``doc`` after ``context``, with the counts of their pair and of themselves."""
        c, n, seen = self.common, self.sums.shape[1], pair > 0
        add = lambda k, x, d=doc: np.add(self.sums[k], np.bincount(d, x, n), out=self.sums[k])
        add(0, np.where(seen, np.log10(np.maximum(pair, 1)), 0.0))
        for r in range(1, CUT + 1):
            add(r, (pair == r).astype(float))
        add(CUT + 1, np.where(seen, np.log10(c.context[context] + 1), 0.0))
        add(CUT + 2, (single > 0).astype(float))
        add(CUT + 3, np.log10(single + 1.0))
        add(CUT + 4, np.where(seen, 0.0, c.log_single(single)))
        add(CUT + 5, np.where(single < c.floor, np.log10(single + 1.0), 0.0))
        asked = ~seen & ~c.rare(context)
        self.unseen.append((doc[asked], context[asked]))

    def state(self) -> list[bytes]:
        doc, context = (np.concatenate([u[k] for u in self.unseen]) if self.unseen else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(doc, kind="stable")
        return [self.sums.tobytes(), steps(doc[order]), pack_ints(context[order])]

    def restore(self, state: list[bytes]) -> None:
        """Takes over what another tally of the same documents holds."""
        self.sums += np.frombuffer(state[0]).reshape(self.sums.shape)
        self.unseen.append((unsteps(state[1]), unpack_ints(state[2])))

    def rows(self) -> tuple[np.ndarray, list[bytes]]:
        doc, context = (np.concatenate([u[k] for u in self.unseen]) if self.unseen else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(self.sums.shape[1] + 1))
        return self.sums, [pack_ints(np.sort(context[order[a:b]])) for a, b in zip(cut, cut[1:])]


def context_sums(context: np.ndarray, pair: np.ndarray, single: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """Per context that occurs: of its distinct seen pairs how many were seen 1..CUT times,
    and the single-token probability of their second tokens."""
    used, place = np.unique(context, return_inverse=True)
    out = np.zeros((CUT + 1, len(used)))
    for r in range(1, CUT + 1):
        out[r - 1] = np.bincount(place, pair == r, len(used))
    out[CUT] = np.bincount(place, 10 ** common.log_single(single), len(used))
    return used, out


def key_runs(bucket: np.ndarray, rare: np.ndarray, token: np.ndarray, context: np.ndarray, history: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of a batch's tokens by bucket in which equal pairs stand together, common second
    tokens first, and a mark where the next pair begins (a pair may begin twice if hashes collide)."""
    half = (62 - (2 * buckets).bit_length()) // 2
    lead = np.where(~rare & (history >= 0), history, token)  # repeated codes of 8 bytes side by side, which compresses them
    rest = token * np.int64(0x1F123BB5) ^ history * np.int64(0x2545F491) ^ context
    lead, rest = ((mix64(x.view(np.uint64)) >> np.uint64(64 - half)).astype(np.int64) for x in (lead, rest))
    order = np.argsort(((bucket * 2 + rare) << half | lead) << half | rest, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in (token[order], context[order], history[order]):
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _send(held, dense_held, buckets: int):
    """Batches -> requests to buckets, one row per distinct pair, and one row per batch that passes
    through: sums of its common pairs, tokens of each document, and the documents of each pair."""
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common, dense = held.value, dense_held.value
        task, number = TaskContext.get().partitionId(), 0
        for ids, train, doc, context, token, before in Batcher(common).batches(stream):
            batch_id, number = task << 32 | number, number + 1
            h = common.dense_context(context)
            inside = (h >= 0) & (token < common.dense)
            own = Tally(len(ids), common)
            t, h = token[inside], h[inside]
            own.add(doc[inside], context[inside], dense[h * common.dense + t], common.counts[t])
            sizes = np.bincount(doc, minlength=len(ids))
            doc, context, token, before = doc[~inside], context[~inside], token[~inside], before[~inside]
            history = np.where(common.rare(context), before, -1)
            mixed = (token * np.int64(0x1F123BB5) + context * np.int64(0x2545F491)) * np.int64(0x27D4EB2F165667C5 >> 1)
            rare = token >= len(common.tokens)
            bucket = bucket_of(np.where(rare, token, np.where(history >= 0, history, mixed)), buckets)
            order, new = key_runs(bucket, rare, token, context, history, buckets)
            local = [*own.state(), pack_ints(sizes), pack_ints(doc[order]), np.packbits(new).tobytes()]
            out = [(batch_id % buckets, batch_id, len(ids), train, None, ids, local)]
            first = np.flatnonzero(new)
            key = order[first]
            learned = np.add.reduceat(doc[order] < train, first, dtype=np.int64) if len(first) else first
            asked = np.diff(np.append(first, len(order))) > learned
            bucket, token, context, history, rare = bucket[key], token[key], context[key], history[key], rare[key]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                span = slice(cut[b], cut[b + 1])
                t, r, h = token[span], rare[span], history[span]
                blob = [pack_ints(t[~r]), pack_ints(t[r] & MASK), pack_ints(context[span]), pack_ints(h[h >= 0] & MASK), pack_ints(learned[span]),
                        np.packbits(asked[span]).tobytes()]
                out.append((int(b), batch_id, len(ids), train, blob, None, None))
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out[i:i + 512]), _SENT_TYPES)], names=_SENT)

    return run


_SENT = ["bucket", "batch", "docs", "train", "request", "ids", "local"]
_SENT_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
_SENT_DDL = "bucket int, batch bigint, docs int, train int, request array<binary>, ids array<bigint>, local array<binary>"
_ANSWER_DDL = "target bigint, bucket int, train int, answer array<binary>, ids array<bigint>, contexts binary, figures binary, of_counts array<bigint>"
_ANSWER_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _history_rows(code: np.ndarray, pair: np.ndarray, single: np.ndarray, needed: np.ndarray, own: int, buckets: int) -> list[tuple[int, list[bytes]]]:
    """(bucket, [needed, histories, pairs of each, their counts, their second tokens' counts]):
    seen pairs of rare histories, for the bucket of their history; ``needed``: the own
    bucket's histories that held-out texts hold."""
    to = bucket_of(code | 1 << 62, buckets)
    keep = (to != own) | np.isin(code, needed)
    code, pair, single, to = code[keep], pair[keep], single[keep], to[keep]
    order = np.lexsort((code, to))
    code, pair, single, to = code[order], pair[order], single[order], to[order]
    out = []
    for b in sorted({own, *np.unique(to).tolist()}):
        span = slice(*np.searchsorted(to, [b, b + 1]))
        codes, sizes = np.unique(code[span], return_counts=True)
        out.append((b, [pack_ints(needed if b == own else needed[:0]), pack_ints(codes), pack_ints(sizes), pack_ints(np.minimum(pair[span], CUT + 1)), pack_ints(single[span])]))
    return out


def _answer(held, buckets: int):
    """One bucket: counts its pairs and rare tokens, answers every batch."""
    def run(table: pa.Table) -> pa.Table:
        common = held.value
        rows = table.to_pylist()
        bucket = int(rows[0]["bucket"])
        out = [(r["batch"], bucket, r["train"], r["local"], r["ids"], None, None, None) for r in rows if r["ids"] is not None]
        requests = [r for r in rows if r["request"] is not None]
        parts = []
        for r in requests:
            known, rare, h, before, learned, asked = r["request"]
            token = np.concatenate([unpack_ints(known), unpack_ints(rare) | 1 << 62])
            h = unpack_ints(h)
            history = np.full(len(h), -1, np.int64)
            history[common.rare(h)] = unpack_ints(before)
            parts.append((token, h, unpack_ints(learned), history, np.unpackbits(np.frombuffer(asked, np.uint8), count=len(h)).astype(bool)))
        if parts:
            token, context, learned, history, asked = (np.concatenate(p) for p in zip(*parts))
            tokens, t = np.unique(token, return_inverse=True)
            single = np.bincount(t, learned, len(tokens)).astype(np.int64)
            known = tokens < len(common.tokens)
            single[known] = common.counts[tokens[known]]
            hot = len(common.context)
            rare = history >= 0
            histories, place = np.unique(history[rare], return_inverse=True)
            context[rare] = hot + place
            wide = hot + len(histories)
            pairs, p = np.unique(t * np.int64(wide) + context, return_inverse=True)
            pair = np.bincount(p, learned, len(pairs)).astype(np.int64)
            seen = pair > 0
            seen_context, seen_pair, seen_single = pairs[seen] % wide, pair[seen], single[pairs[seen] // wide]
            few = seen_context >= hot
            used, figures = context_sums(seen_context[~few], seen_pair[~few], seen_single[~few], common)
            of = np.bincount(np.minimum(pair[seen], CUT + 2), minlength=CUT + 3)[:CUT + 2]
            out.append((-1 - bucket % parts_of(buckets), bucket, 0, None, None, pack_ints(used), figures.tobytes(), of.tolist()))
            if not common.lumped:
                needed = np.unique(token[(token >= len(common.tokens)) & asked]) & MASK
                for b, blob in _history_rows(histories[seen_context[few] - hot], seen_pair[few], seen_single[few], needed, bucket, buckets):
                    out.append((HISTORIES - b, bucket, 0, blob, None, None, None, None))
            at = 0
            for r, (_, h, _, before, _) in zip(requests, parts):
                span = slice(at, at + len(h))
                n = pair[p[span]]
                answer = [pack_ints(h), pack_ints(n), pack_ints(single[t[span]]), pack_ints(before[(before >= 0) & (n == 0)])]
                out.append((r["batch"], bucket, r["train"], answer, None, None, None, None))
                at += len(h)
        names = [f.split()[0] for f in _ANSWER_DDL.split(", ")]
        return pa.Table.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), _ANSWER_KINDS)], names=names)

    return run


_DOC_DDL = "batch bigint, place int, bucket int, histories array<binary>, doc_id bigint, held_out boolean, n_tokens bigint, sums array<double>, unseen binary, contexts binary, figures binary, of_counts array<bigint>"
_DOC_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _history_figures(rows: list[list[bytes]], common: Common) -> tuple[np.ndarray, np.ndarray]:
    """Needed histories of one bucket (sorted) and what ``context_sums`` gives for them."""
    needed = np.unique(np.concatenate([unpack_ints(r[0]) for r in rows]))
    out = np.zeros((CUT + 1, len(needed)))
    for _, codes, sizes, pair, single in (map(unpack_ints, r) for r in rows):
        code = np.repeat(codes, sizes)
        at = np.searchsorted(needed, code)
        keep = at < len(needed)
        keep[keep] = needed[at[keep]] == code[keep]
        used, own = context_sums(at[keep], pair[keep], single[keep], common)
        out[:, used] += own
    some = out.any(axis=0)
    return needed[some], out[:, some]


def _gather(held, buckets: int):
    """One batch: adds the answers up per document (or one part of the contexts' sums)."""
    def run(table: pa.Table) -> pa.Table:
        common = held.value
        rows = table.to_pylist()
        names = [f.split()[0] for f in _DOC_DDL.split(", ")]
        if rows[0]["target"] <= HISTORIES:
            codes, total = _history_figures([r["answer"] for r in rows], common)
            out = [(None, None, HISTORIES - rows[0]["target"], [pack_ints(codes)], None, None, None, None, None, None, total.tobytes(), None)]
        elif rows[0]["contexts"] is not None:
            total, of = np.zeros((CUT + 1, len(common.context))), np.zeros(CUT + 2, np.int64)
            for r in rows:
                used = unpack_ints(r["contexts"])
                total[:, used] += np.frombuffer(r["figures"]).reshape(CUT + 1, -1)
                of += r["of_counts"]
            used = np.flatnonzero(total.any(axis=0))
            out = [(None, None, None, None, None, None, None, None, None, pack_ints(used), total[:, used].tobytes(), of.tolist())]
        else:
            head = next(r for r in rows if r["ids"] is not None)
            ids = head["ids"]
            tally = Tally(len(ids), common)
            *state, sizes, doc, new = head["answer"]
            tally.restore(state)
            tokens, doc = unpack_ints(sizes), unpack_ints(doc)
            answers = [r["answer"] for r in sorted(rows, key=lambda r: r["bucket"]) if r["ids"] is None]  # in the order of the pairs
            history = np.empty(0, np.int64)
            if answers:
                context, pair, single, before = (np.concatenate([unpack_ints(a[k]) for a in answers]) for k in range(4))
                key = np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=len(doc)), dtype=np.int64) - 1
                tally.add(doc, context[key], pair[key], single[key])
                asked = np.full(len(context), -1, np.int64)
                asked[common.rare(context) & (pair == 0)] = before
                history = asked[key]
                doc, history = doc[history >= 0], history[history >= 0]
            sums, unseen = tally.rows()
            batch = rows[0]["target"]
            out = [(batch, k, None, None, i, k >= head["train"], int(tokens[k]), sums[:, k], unseen[k], None, None, None) for k, i in enumerate(ids)]
            to = bucket_of(history | 1 << 62, buckets)
            order = np.lexsort((doc, to))
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                pick = order[cut[b]:cut[b + 1]]
                out.append((batch, None, b, [steps(doc[pick]), pack_ints(history[pick])], *[None] * 8))
        return pa.Table.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), _DOC_KINDS)], names=names)

    return run


def _add_up(contexts: int):
    """The tables of the contexts' sums in one task as one row per context, and the counts of
    counts as rows -1, -2, ..."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((CUT + 1, contexts)), np.zeros(CUT + 2, np.int64)
        for batch in batches:
            for used, figures, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total[:, unpack_ints(used)] += np.frombuffer(figures).reshape(CUT + 1, -1)
                of += counts
        used = np.flatnonzero(total.any(axis=0))
        rows = np.zeros((CUT + 1, len(of)))
        rows[0] = of
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(len(of)), used]), pa.int32()),
                                          *(pa.array(np.concatenate([r, t])) for r, t in zip(rows, total[:, used]))], names=["context", *_FIGURES])

    return run


_FIGURES = [f"figure_{r}" for r in range(CUT + 1)]


def _histories(model_held):
    """One bucket of rare histories: what the unseen pairs of each document add."""
    def run(table: pa.Table) -> pa.Table:
        model, known, weight = model_held.value, np.empty(0, np.int64), np.empty(0)
        rows = table.to_pylist()
        for r in rows:
            if r["figures"] is not None:
                known = unpack_ints(r["histories"][0])
                weight = model.log_left(np.frombuffer(r["figures"]).reshape(CUT + 1, -1))
        known, weight = np.append(known, 1 << 62), np.append(weight, 0.0)  # histories that training texts don't hold add 0
        batch, place, extra = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for r in rows:
            if r["figures"] is None:
                doc, code = unsteps(r["histories"][0]), unpack_ints(r["histories"][1])
                at = np.searchsorted(known, code)
                docs, inverse = np.unique(doc, return_inverse=True)
                batch.append(np.full(len(docs), r["batch"], np.int64))
                place.append(docs)
                extra.append(np.bincount(inverse, np.where(known[at] == code, weight[at], 0.0), len(docs)))
        return pa.table([pa.array(np.concatenate(x), k) for x, k in ((batch, pa.int64()), (place, pa.int32()), (extra, pa.float64()))], names=["batch", "place", "extra"])

    return run


class Model:
    """Figures of fixed size that turn a document's sums into its score."""

    def __init__(self, common: Common, figures: np.ndarray, of_counts: dict[int, int]):
        self.pair_discount = discounts(of_counts)
        self.log_end = common.log_end
        self.log_alpha = self.log_left(figures) - np.log10(common.context + 1)

    def log_left(self, figures: np.ndarray) -> np.ndarray:
        """log10 of alpha(h) (c(h) + 1) from the figures of ``context_sums``."""
        lost = sum((1 - self.pair_discount[r]) * r * figures[r - 1] for r in range(1, CUT + 1))
        return np.log10(lost + 1) - np.log10(np.maximum(1 - figures[CUT], 1e-12))

    def score(self, sums: np.ndarray, unseen: np.ndarray) -> float:
        seen = sums[0] + sum(sums[r] * np.log10(self.pair_discount[r]) for r in range(1, CUT + 1)) - sums[CUT + 1]
        rare = sums[CUT + 5] - self.log_end  # each document holds one end mark
        return float(seen - rare + sums[CUT + 4] + self.log_alpha[unseen].sum())


def score_texts(docs: DataFrame, held_out_fold: int = 2, folds: int = 7, contexts: int | None = None, hot: int = CONTEXTS) -> DataFrame:
    """The contract's rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every token is a context, those of the ``hot`` commonest by broadcast; with ``contexts``,
    only that many are, and all rarer ones form one class.
    """
    lumped = contexts is not None
    most = contexts if lumped else hot
    spark = docs.sparkSession
    is_held = F.coalesce(crc_mod(F.col("doc_id").cast("bigint"), folds) == held_out_fold, F.lit(False))
    rows = ids_and_texts(docs, is_held.alias("held_out"))
    singles = staged(single_counts(rows.filter(~F.col("held_out"))), "tokens")
    # counts of counts up to CUT + 1, and of coarser steps beyond: at most about 4,000 rows
    step = F.when(F.col("n") <= CUT + 1, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 1_000)
    bins = sorted((r["step"], r["k"], r["n"]) for r in singles.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect())
    least, kept = 0, 0
    for b, k, _ in reversed(bins):
        if kept + k >= most:
            least = b + 1
            break
        kept += k
    top = singles.filter((step >= least) | (F.col("token") == END)).select("token", "n").toArrow()  # at most ``most`` tokens
    tokens, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.lexsort((tokens, -counts))
    tokens, counts = tokens[order], counts[order]
    texts = int(counts[tokens == END].sum())
    total, distinct = sum(n for _, _, n in bins), sum(k for _, k, _ in bins)
    common = Common(tokens, counts, total, distinct, texts, {b: k for b, k, _ in bins if b <= CUT + 1}, lumped)
    sc = spark.sparkContext
    held = Shipped(spark, common)
    dense = np.zeros((common.dense + 2) * max(1, common.dense), np.int64)
    found = dense_pairs(rows.filter(~F.col("held_out")), held).toArrow()  # at most (DENSE + 2) * DENSE pairs
    dense[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    dense_held = sc.broadcast(dense)
    buckets = int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_TOKENS + 1))
    sent = rows.mapInArrow(_send(held, dense_held, buckets), _SENT_DDL)
    answers = sent.groupBy("bucket").applyInArrow(_answer(held, buckets), _ANSWER_DDL)
    gathered = staged(answers.groupBy("target").applyInArrow(_gather(held, buckets), _DOC_DDL), "documents")

    held_figures, of_pairs = np.zeros((CUT + 1, len(common.context))), np.zeros(CUT + 2, np.int64)
    own_figures = gathered.filter("contexts is not null").select("contexts", "figures", "of_counts").mapInArrow(
        _add_up(len(common.context)), "context int, " + ", ".join(f"{f} double" for f in _FIGURES))
    added = own_figures.groupBy("context").agg(*(F.sum(f).alias(f) for f in _FIGURES)).toArrow()  # a row per common context
    at = added.column("context").to_numpy()
    for r, f in enumerate(_FIGURES):
        held_figures[r, at[at >= 0]] = added.column(f).to_numpy()[at >= 0]
    of_pairs[-1 - at[at < 0]] += added.column(_FIGURES[0]).to_numpy()[at < 0].astype(np.int64)
    pairs = np.flatnonzero(dense)
    if len(pairs):
        h, w = pairs // common.dense, pairs % common.dense
        context = np.where(h < common.dense, h, common.begin + h - common.dense)
        used, own = context_sums(context, dense[pairs], common.counts[w], common)
        held_figures[:, used] += own
        of_pairs += np.bincount(np.minimum(dense[pairs], CUT + 2), minlength=CUT + 3)[:CUT + 2]
    model = Shipped(spark, Model(common, held_figures, dict(enumerate(of_pairs.tolist()))))
    n, v = int(total), int(distinct)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, per_token = model.value, np.log10(n + v + 1)
        for batch in batches:
            sums = [np.array(s) for s in batch.column(5).to_pylist()]
            tokens = np.array(batch.column(4).to_pylist(), float)
            scores = [m.score(s, unpack_ints(u)) for s, u in zip(sums, batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in range(5)), pa.array([int(s[CUT + 2]) for s in sums], pa.int64()), pa.array([n] * len(sums), pa.int64()),
                pa.array([s[CUT + 3] - t * per_token for s, t in zip(sums, tokens)], pa.float64()), pa.array(scores, pa.float64())],
                names=["batch", "place", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = gathered.filter("contexts is null and bucket is null").select("batch", "place", "doc_id", "held_out", "n_tokens", "sums", "unseen").mapInArrow(
        finish, "batch bigint, place int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    rare = gathered.filter("bucket is not null").select("batch", "bucket", "histories", "figures").groupBy("bucket").applyInArrow(
        _histories(model), "batch bigint, place int, extra double").groupBy("batch", "place").agg(F.sum("extra").alias("extra"))
    return own.join(rare, ["batch", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
