"""Quality classifier: a factorisation machine over hashed words and structure.

Inputs of a document are its hashed words (term frequencies, unit length) and
statistics of its structure and size, each cut into bins at quantiles of the
training sample.  The model is ``w0 + w x + sum_{i<j} <v_i, v_j> x_i x_j``; the
pairwise part is computed in linear time as half of the squared sums minus the
sums of squares, per factor.  It is fitted by AdaGrad on the logistic loss, on
a bounded sample of labelled rows (``max_rows``), and every text is then scored
whole, in the tasks.

Defined results: null and empty texts have no words and zero statistics and
get a score like any other; repeated rows get equal scores; other columns,
labels, language, source and id are no inputs; without any labelled row the
model is the constant 0.5.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.llm.common import Shipped, crc_mod, ids_and_texts, map_batches, texts_of, unused
from funnelwise.llm.labelled import labelled_sample

MAX_ROWS = 20_000
WORD_BITS = 15
FACTORS = 8
BINS = 12
THRESHOLD = 0.7

# classes of bytes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line feed, 6 symbol, 7 plain punctuation, 8 part of a non-ASCII character
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 32, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 7
_CLASS[128:] = 8
# bytes that separate words (as bytes.split does), and ASCII bytes that end a word of mixed kind
_GAP, _MIXED = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_MIXED[[c for c in range(128) if not chr(c).isalnum() and chr(c) not in ".,;:'\")?"]] = True

STATS = ["log_bytes", "log_lines", "upper", "digit", "symbol", "punctuation", "non_ascii", "pipe", "exclaim", "word_length", "distinct_words",
         "top_word", "repeated_lines", "line_words", "mixed_words", "repeated_pairs"]


def statistics(text: bytes, words: list[bytes], codes: np.ndarray, counts: np.ndarray) -> list[float]:
    """The values of ``STATS`` for one text; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    n = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    size, letters, many = len(text), max(1, int(n[1] + n[2] + n[8])), max(1, len(words))
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    pairs = codes[1:] * np.int64(1 << WORD_BITS) + codes[:-1]
    raw = np.frombuffer(text, np.uint8)
    mixed = int(_MIXED[raw[~_GAP[raw] & np.append(_GAP[raw[1:]], True)]].sum()) / many  # over the last bytes of all words
    return [np.log1p(size), np.log1p(len(lines)), n[2] / letters, n[3] / size, n[6] / size, n[7] / size, n[8] / letters, text.count(b"|") / many,
            text.count(b"!") / many, (size - n[4] - n[5]) / many, len(counts) / many, int(counts.max(initial=0)) / many, 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(many / max(1, len(lines))), mixed, 1 - len(np.unique(pairs)) / max(1, len(pairs))]


class Buckets(dict):
    """word -> hashed index; emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 5) >> (64 - WORD_BITS)
        return value


def words_and_stats(text: bytes | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Distinct hashed words, their unit-length weights, and the statistics."""
    words = text.split() if text else []
    codes = np.fromiter(map(buckets.__getitem__, map(bytes.lower, words)), np.int64, len(words))
    index, counts = np.unique(codes, return_counts=True)
    value = np.log1p(counts)
    norm = np.sqrt((value * value).sum())
    return index, value / norm if len(index) else value, statistics(text or b"", words, codes, counts)


class FactorisationMachine:
    def __init__(self, edges: np.ndarray, seed: int = 1):
        """``edges``: bin borders, one row per statistic."""
        self.edges = edges
        size = (1 << WORD_BITS) + edges.shape[0] * (edges.shape[1] + 1)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))

    def inputs(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = np.array([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats)], np.int64)
        width = self.edges.shape[1] + 1
        extra = (1 << WORD_BITS) + np.arange(len(bins)) * width + bins
        return np.concatenate([index, extra]), np.concatenate([value, np.full(len(bins), len(bins) ** -0.5)])

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        return self.w0 + float(self.w[index] @ value) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx ** 2).sum(axis=0)).sum())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -30, 30))))

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5,
            batch: int = 64, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        mean = np.clip(target.mean(), 0.02, 0.98)
        self.w0 = float(np.log(mean / (1 - mean)))
        g0, gw, gv = 1.0, np.full(len(self.w), 0.1), np.full(self.v.shape, 0.1)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                chosen = [rows[r] for r in part]
                sizes = [len(i) for i, _ in chosen]
                index, value = (np.concatenate([c[k] for c in chosen]) for k in (0, 1))
                start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                vx = self.v[index] * value[:, None]
                sums = np.add.reduceat(vx, start, axis=0)
                raw = self.w0 + np.add.reduceat(self.w[index] * value, start) + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, start, axis=0)).sum(axis=1)
                wrong = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target[part]
                each = np.repeat(wrong, sizes) * value
                used, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, each, len(used)) + decay * self.w[used]
                inner = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                gw[used] += dw ** 2
                gv[used] += dv ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                g0 += wrong.sum() ** 2
                self.w0 -= rate * wrong.sum() / np.sqrt(g0)


def features(sample: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        buckets = Buckets()
        out = [words_and_stats(t, buckets) for t in texts_of(batch)]
        return {"target": batch.column(2), "words": [i.astype(np.int32).tobytes() for i, _, _ in out],
                "weights": [v.astype(np.float32).tobytes() for _, v, _ in out], "stats": [s for _, _, s in out]}

    return map_batches(sample, run, "target double, words binary, weights binary, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, column: str = "quality", max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on at most about ``max_rows`` labelled rows of those where ``learn`` (over doc_id) holds."""
    learn = F.lit(True) if learn is None else learn
    # about max_rows rows at most; sorted, so that the fit doesn't depend on the order of tasks
    table = features(labelled_sample(docs, labels, column, learn, max_rows)).toArrow()
    if not len(table):
        return FactorisationMachine(np.zeros((len(STATS), BINS - 1)))
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("words", "weights", "target")]).to_numpy()
    stats = table.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(STATS))[order]
    target = table.column("target").to_numpy()[order]
    words, weights = (table.column(c).combine_chunks() for c in ("words", "weights"))
    del table
    machine = FactorisationMachine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T)
    machine.fit(Inputs(machine, words, weights, order, stats), target)
    return machine


class Inputs(Sequence):
    """Inputs of the sample's rows, cut from flat arrays when they are asked for."""

    def __init__(self, machine: FactorisationMachine, words: pa.BinaryArray, weights: pa.BinaryArray, order: np.ndarray, stats: np.ndarray):
        self.machine, self.order, self.stats = machine, order, stats
        # the sample's values lie one after another in the two columns' buffers
        self.at = [np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1] // 4 for a in (words, weights)]
        self.index, self.value = np.frombuffer(words.buffers()[2], np.int32), np.frombuffer(weights.buffers()[2], np.float32)

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        r = self.order[k]
        (a, b), (c, d) = ((at[r], at[r + 1]) for at in self.at)
        return self.machine.inputs(self.index[a:b].astype(np.int64), self.value[c:d].astype(float), self.stats[k])


def scores(docs: DataFrame, machine: FactorisationMachine, keep: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row; with ``keep``, those columns and a last one with the score."""
    held = Shipped(docs.sparkSession, machine)  # fixed size

    def score(texts: list[bytes | None]) -> list[float]:
        fm, buckets = held.value, Buckets()
        out = []
        for text in texts:
            index, value, stats = words_and_stats(text, buckets)
            out.append(fm.score(*fm.inputs(index, value, np.array(stats))))
        return out

    if keep is None:
        return map_batches(ids_and_texts(docs), lambda b: {"doc_id": b.column(0), "score": score(texts_of(b))}, "doc_id bigint, score double")
    name = unused(docs, "score")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{name}` double"])
    return map_batches(docs, lambda b: {**{c: b.column(b.schema.get_field_index(c)) for c in keep}, name: score(texts_of(b))}, ddl)


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, folds: int = 4) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, crc_mod(F.col("doc_id"), folds) != held_out_fold)
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return scores(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; fitted on all labelled rows' sample."""
    machine = train(docs, labels)
    scored = scores(docs, machine, docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
