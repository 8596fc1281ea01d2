"""A bounded, spread-out sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.llm.common import WordHashes, ids_and_texts, map_batches, shingle_hashes, space_words, staged, texts_of


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, target) of at most about ``max_rows`` labelled rows where ``learn`` holds.

    Rows are chosen by a hash of their id, so the choice is the same in every
    run and doesn't follow the table's order.  Of documents whose smallest
    five-word shingle hash agrees (copies and near copies) one stays, so a group
    of copies counts as one example.  Null labels are left out; a document
    with several labels gets their mean.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("double").alias("target"))
             .filter(F.col("doc_id").isNotNull() & F.col("target").isNotNull() & learn))
    known = staged(known.groupBy("doc_id").agg(F.avg("target").alias("target")), "known")
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows rows of 16 bytes
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")

    def keyed(batch: pa.RecordBatch) -> dict:
        words, keys = WordHashes(), []
        for k, text in enumerate(texts_of(batch)):
            s = shingle_hashes(words.array(space_words(text)), 5)
            keys.append(int(s[0]) >> 1 if len(s) else -1)
        return {"doc_id": batch.column(0), "text": batch.column(1), "target": batch.column(2), "likeness": keys}

    rows = map_batches(rows, keyed, "doc_id bigint, text string, target double, likeness bigint")
    one = rows.groupBy("likeness").agg(F.min(F.struct("doc_id", "text", "target")).alias("one"))  # the same one in every run
    return staged(one.select("one.*"), "sample")
