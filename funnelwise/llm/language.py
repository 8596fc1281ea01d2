"""Language identification by nearest centroids.

A text's letters become lower-case words between blanks; runs of 2 to 4 bytes are
hashed to ``2 ** BITS`` inputs, weighted ``log(1 + count) * idf`` and scaled to
length one.  The document frequencies behind idf are counted over all training texts.
Each language's texts (a bounded sample, ``PER_LANGUAGE``, spread by a hash of
the id) are clustered by spherical k-means into up to ``CLUSTERS`` centroids, where
Spark groups them by language.  A text gets the language of the centroid with the largest cosine.

Distance-based rejection: each centroid has a radius, the distance that
``WITHIN`` of its own sample keeps below, widened by ``SLACK``.  A text beyond the
radius of its nearest centroid is marked ``rejected``; its score is scaled down by how far it lies outside,
its language stays the nearest one.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not rejected;
null langs and null doc_ids are never learned from; without anything to learn from all
texts are ``und``; repeated rows get equal results; texts of any length are read whole, in
pieces; ties go to the alphabetically first language; lang, source, doc_id and other columns are no
inputs.  At most the ``MAX_LANGUAGES`` most frequent langs are learned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.llm.common import crc_mod, ids_and_texts, map_batches, staged, texts_of

BITS = 14
SIZES = (2, 3, 4)
CLUSTERS = 4
STEPS = 8
#: Texts per language that the clustering sees, about; and languages.
PER_LANGUAGE = 1_000
MAX_LANGUAGES = 256
WITHIN, SLACK = 0.99, 1.15
#: Difference of cosines that counts as one step of confidence.
SOFT = 0.03
UNKNOWN = "und"
_PIECE = 1 << 20

# bytes of letters stay (a-z, parts of non-ASCII characters), A-Z is lowered, all others are blanks
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes | None) -> bool:
    """Whether a text holds a letter of any script."""
    if not text:
        return False
    if len(text.translate(None, _ASCII_LETTERS)) < len(text):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace"))) if max(text) >= 128 else False


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, how often) of a whole text, taken piece by piece."""
    total = np.zeros(1 << BITS, np.int64)
    carry = np.array([32], np.uint8)
    for at in range(0, max(1, len(text)), _PIECE):
        raw = np.concatenate([carry, _LETTER[np.frombuffer(text[at:at + _PIECE], np.uint8)]])
        last = at + _PIECE >= len(text)
        if last:
            raw = np.append(raw, np.uint8(32))
        blank = raw == 32
        raw = raw[~(blank & np.append([False], blank[:-1]))].astype(np.uint64)  # one blank between words
        new = 0 if at == 0 else len(carry)
        for size in SIZES:
            # runs that end in this piece; earlier ones are counted already
            start = max(0, new - size + 1) if at else 0
            if len(raw) - start < size:
                continue
            code = np.full(len(raw) - start - size + 1, size, np.uint64)
            for i in range(size):
                code = code * np.uint64(257) + raw[start + i:len(raw) - size + 1 + i]
            code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            total += np.bincount(code.astype(np.int64), minlength=1 << BITS)
        carry = raw[-(max(SIZES) - 1):].astype(np.uint8)
    index = np.flatnonzero(total)
    return index, total[index]


def vector(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights (length one) of a text's TF-IDF vector."""
    index, counts = gram_counts(text)
    value = np.log1p(counts) * idf[index]
    norm = np.sqrt(value @ value)
    return index, (value / norm if norm > 0 else value).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each hashed n-gram the number of texts (with a letter) that hold it, and the number of these texts."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in texts_of(batch):
                if has_letter(text):
                    found[gram_counts(text)[0]] += 1
                    n += 1
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(found[used], n))], names=["gram", "n"])

    rows = texts.select("text").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 2 ** BITS + 1 rows
    out, n = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r["gram"] < 0:
            n = r["n"]
        else:
            out[r["gram"]] = r["n"]
    return out, n


def cluster(index: list[np.ndarray], value: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Spherical k-means of one language's vectors: (centroid of length one, radius) each."""
    x = np.zeros((len(index), 1 << BITS), np.float32)
    for row, (i, v) in enumerate(zip(index, value)):
        x[row, i] = v
    centres = [x.mean(axis=0)]  # the first centroid, then the vectors farthest from all before
    nearest = x @ (centres[0] / max(1e-12, np.linalg.norm(centres[0])))
    for _ in range(min(CLUSTERS, len(x)) - 1):
        centres.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(STEPS):
        c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
        pick = (x @ c.T).argmax(axis=1)
        used = [k for k in range(len(c)) if (pick == k).any()]
        c = np.stack([x[pick == k].mean(axis=0) for k in used])
    c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    cosine = x @ c.T
    pick, best = cosine.argmax(axis=1), cosine.max(axis=1)
    everyone = float(np.quantile(1 - best, WITHIN))  # for centroids with few members
    return [(c[k], SLACK * (float(np.quantile(1 - best[pick == k], WITHIN)) if (pick == k).sum() >= 20 else everyone)) for k in range(len(c))]


@dataclass
class Model:
    """languages (sorted), owner of each centroid, centroids (inputs x centroids), radii, idf."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def plain(self) -> tuple:
        return self.languages, self.owner, self.centroids, self.radii, self.idf


def predict(plain: tuple, text: bytes | None) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text; ``plain`` as from ``Model.plain``."""
    languages, owner, centroids, radii, idf = plain
    if not languages or not has_letter(text):
        return UNKNOWN, 0.0, False
    index, value = vector(text, idf)
    cosine = value @ centroids[index]
    of = np.full(len(languages), -1.0)
    np.maximum.at(of, owner, cosine)
    best = int(of.argmax())
    k = int(np.where(owner == best, cosine, -2).argmax())
    share = float(1 / np.exp((of - of[best]) / SOFT).sum())
    distance = 1 - float(cosine[k])
    rejected = distance > radii[k]
    if rejected:
        share *= max(0.0, (1 - distance) / (1 - min(radii[k], 0.999)))
    return languages[best], min(1.0, max(0.0, share)), bool(rejected)


def train(docs: DataFrame, learn: Column) -> Model:
    """Fit on the rows where ``learn`` holds and lang is not null."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    found, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + found)) + 0.1
    if not most:
        return Model([], np.zeros(0, np.int64), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), idf)
    # an even share of each language's ids, chosen by their hash
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for r in most:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (spread < F.lit(int(min(1.0, PER_LANGUAGE / r["n"]) * 1_000_000))))

    held = docs.sparkSession.sparkContext.broadcast(idf)  # 2 ** BITS numbers

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("doc_id").to_pylist(), np.int64), kind="stable")
        texts = table.column("text").cast(pa.binary()).to_pylist()
        pairs = [vector(texts[i], held.value) for i in order if has_letter(texts[i])]
        got = cluster([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else []
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(got), pa.string()), "k": pa.array(range(len(got)), pa.int32()),
                         "centroid": pa.array([c.astype(np.float32).tobytes() for c, _ in got], pa.binary()), "radius": pa.array([r for _, r in got], pa.float64())})

    sample = staged(rows.filter(chosen), "languages")
    fitted = sample.groupBy("lang").applyInArrow(fit, "lang string, k int, centroid binary, radius double")  # about PER_LANGUAGE rows a group
    got = sorted(fitted.collect(), key=lambda r: (r["lang"], r["k"]))  # at most MAX_LANGUAGES * CLUSTERS rows
    languages = sorted({r["lang"] for r in got})
    owner = np.array([languages.index(r["lang"]) for r in got], np.int64)
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in got], np.float32).reshape(len(got), 1 << BITS).T
    return Model(languages, owner, np.ascontiguousarray(centroids), np.array([r["radius"] for r in got]), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model.plain())  # at most MAX_LANGUAGES * CLUSTERS centroids of 2 ** BITS numbers

    def run(batch: pa.RecordBatch) -> dict:
        out = [predict(held.value, t) for t in texts_of(batch)]
        return {"doc_id": batch.column(0), "lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "rejected": [o[2] for o in out]}

    return map_batches(ids_and_texts(docs), run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def classify(docs: DataFrame, held_out_fold: int = 0, folds: int = 5) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score (and rejected)."""
    fold = crc_mod(F.col("doc_id").cast("bigint"), folds)
    model = train(docs, fold != held_out_fold)
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
