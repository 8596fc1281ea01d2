"""Document fingerprints: a Merkle tree over sections, paragraphs and segments.

A text is cut at blank lines into sections, at line ends into paragraphs, and
inside a paragraph at word ends chosen by the preceding 16 bytes (about one in
four, one in two near the beginning of the text, for the sake of short texts),
so a cut moves only near an edit.  Segments are hashed; a node's digest is
the hash of its children's digests; the root covers every byte.  Equal roots
mean equal texts; where roots differ, descending into differing branches
(``differences``) locates the edits, and the share of common segments is the
likeness of two texts.

The string holds the whole tree: ``root/section:paragraph=segments;...``, with
8 hex digits per section, paragraph and segment (of two texts with 100,000
segments each, two or three agree by chance).

Next documents: rows are cut into ranges of (doc_id, hash of the text) at
quantiles of doc_id, an id that holds several quantiles (null too) also by hash;
the first row of each range is also sent to the range before it (the very first
to the last), so every range knows its rows' next documents, in one shuffle and
without a global window.  Rows with one id follow each other by the hash of
their text; null ids come last.  A range is sorted by Spark and streamed, so
memory doesn't grow with it; rows equal in id and text stay in one range.

Defined results: null texts count as empty; the empty text has the fingerprint
of a tree without sections; a single row is its own next document; repeated
rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import ids_and_texts, mix64, schema_of

SEGMENT_WORDS = 4
#: Bytes at the beginning of a text that are cut twice as finely.
FINE = 256
DIGITS = 8
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def segment_ends(data: bytes, before: int = 0) -> np.ndarray:
    """Cut positions inside a paragraph (its end included); ``before``: bytes of text before it."""
    n = len(data)
    raw = np.frombuffer(bytes(16) + data, np.uint8)
    at = np.flatnonzero(_BLANK[raw[16:]])
    if not len(at):
        return np.array([n])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    key = mix64(eight[at + 8] * np.uint64(0x9E3779B97F4A7C15) + eight[at])
    every = np.where(at + before < FINE, SEGMENT_WORDS // 2, SEGMENT_WORDS).astype(np.uint64)
    at = at[key % every == 0] + 1
    return at if len(at) and at[-1] == n else np.append(at, n)


def fingerprint(text: str) -> str:
    """The tree of a text as a string."""
    data, sections = text.encode("utf-8", "surrogatepass"), []
    digests, before = [], 0
    for section in data.split(b"\n\n") if data else []:
        paragraphs, below = [], []
        for paragraph in section.split(b"\n"):
            start, hashes = 0, []
            for end in segment_ends(paragraph, before).tolist():
                hashes.append(xxhash.xxh3_64_digest(paragraph[start:end]))
                start = end
            before += len(paragraph) + 1
            digest = xxhash.xxh3_128_digest(b"p" + b"".join(hashes))
            below.append(digest)
            paragraphs.append(digest[:4].hex() + "=" + "".join([h[:DIGITS // 2].hex() for h in hashes]))
        digest = xxhash.xxh3_128_digest(b"s" + b"".join(below))
        digests.append(digest)
        sections.append(digest[:4].hex() + ":" + ";".join(paragraphs))
    return "/".join([xxhash.xxh3_128_digest(b"r" + b"".join(digests)).hex(), *sections])


def _segments(print_: str) -> Counter:
    out: Counter = Counter()
    for section in print_.split("/")[1:]:
        for paragraph in section.partition(":")[2].split(";"):
            s = paragraph.partition("=")[2]
            out.update([s[i:i + DIGITS] for i in range(0, len(s), DIGITS)])
    return out


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else twice the common segments over all segments of both."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _segments(a), _segments(b)
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers in ``b`` whose digests ``a`` doesn't hold at that level."""
    if a[:32] == b[:32]:
        return []
    known = {s.partition(":")[0] for s in a.split("/")[1:]}
    held = {p.partition("=")[0] for s in a.split("/")[1:] for p in s.partition(":")[2].split(";")}
    return [(i, j) for i, s in enumerate(b.split("/")[1:]) if s.partition(":")[0] not in known
            for j, p in enumerate(s.partition(":")[2].split(";")) if p.partition("=")[0] not in held]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _even_cuts(parts: int) -> np.ndarray:
    """Upper bounds of ``parts`` equal parts of the 64-bit integers."""
    return np.array([(i << 64) // parts - (1 << 63) - 1 for i in range(1, parts + 1)], np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """(range_no, extra, doc_id, text), partitioned by range and sorted so that each row is
    followed by its next document; ``extra`` rows only end a range."""
    spark = docs.sparkSession
    rows = ids_and_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = max(1, min(10_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges), F.count("doc_id"), F.count(F.lit(1))).first()
    unnamed = whole[2] - whole[1]
    cuts = np.array(whole[0] or [], np.int64)
    ids, copies = np.unique(cuts, return_counts=True)
    cut_ids = np.repeat(ids, copies)  # an id with several quantiles is cut by hash as often
    cut_keys = np.concatenate([_even_cuts(n) for n in copies.tolist()] or [cuts])
    null_keys = _even_cuts(max(1, round(ranges * unnamed / max(whole[1], 1)) if unnamed < whole[1] else ranges))[:-1]

    @F.pandas_udf("int")
    def range_no(ids: pd.Series, keys: pd.Series) -> pd.Series:
        unnamed, keys = ids.isna().to_numpy(), keys.to_numpy(np.int64)
        known = (ids.fillna(0).astype("int64") if ids.dtype != "int64" else ids).to_numpy()
        at, end = np.searchsorted(cut_ids, known, "left"), np.searchsorted(cut_ids, known, "right")
        for i in np.unique(at[end - at > 1]).tolist():  # ids with cuts of their own
            rows = np.flatnonzero((at == i) & (end - at > 1))
            at[rows] += np.searchsorted(cut_keys[i:end[rows[0]]], keys[rows], "left")
        at = len(cut_ids) - at
        at[unnamed] = len(cut_ids) + 1 + len(null_keys) - np.searchsorted(null_keys, keys[unnamed], "left")
        return pd.Series(at.astype("int32"))

    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("range_no", range_no("doc_id", "text_key"))
    order = F.struct(F.col("doc_id"), F.col("text_key"))
    heads = sorted((r[0], r[1]["doc_id"], r[1]["text_key"]) for r in rows.groupBy("range_no").agg(F.max(order)).collect())  # one small row a range
    if not heads:
        return rows.select("range_no", F.lit(False).alias("extra"), "doc_id", "text")
    ends = spark.createDataFrame([(heads[i - 1][0], *heads[i]) for i in range(len(heads))], "to_range int, range_no int, head_id bigint, head_key bigint")
    rows = rows.join(F.broadcast(ends), "range_no", "left")  # at most 20,001 rows
    own = F.struct("range_no", F.lit(False).alias("extra"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_key") == F.col("head_key"))
    rows = rows.withColumn("place", F.explode(F.when(is_head, F.array(own, F.struct(F.col("to_range").alias("range_no"), F.lit(True).alias("extra")))).otherwise(F.array(own))))
    rows = rows.select("place.range_no", "place.extra", "doc_id", "text_key", "text")
    rows = rows.repartition("range_no").sortWithinPartitions("range_no", "extra", F.col("doc_id").desc_nulls_last(), F.col("text_key").desc())
    return rows.select("range_no", "extra", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = schema_of(docs.sparkSession, ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range_no, doc_id, text, fingerprint) of the row before
        for batch in batches:
            out = []
            for range_no, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                here = (range_no, doc_id, text, fingerprint(text))
                if last and last[0] == range_no:
                    new = edited(last[2], text)
                    print_ = fingerprint(new)
                    out.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[3], print_,
                                likeness(last[3], print_), likeness(last[3], here[3])))
                last = None if extra else here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return with_next(docs).mapInArrow(run, ddl)
