"""Token counts of a unigram segmentation by dynamic programming over shared prefixes.

A text's pre-tokens are its maximal runs of characters other than space, tab,
line feed, vertical tab, form feed and carriage return; each begins with the
word mark.  A pre-token's segmentation is the one with the greatest sum of
piece scores, fewest pieces among equals; a character that no piece covers
falls back to its UTF-8 bytes, one token each.  Piece scores follow Zipf's law
on the pieces' ranks in the public vocabulary file (nothing is trained).

The distinct new pre-tokens of a batch are walked in sorted order, i.e. as a
depth-first walk of their trie: the forward scores of a prefix are computed
once and shared by all pre-tokens that begin with it; the counts at terminal
nodes are kept for the whole task.

Defined results: null and empty texts have 0 characters, pre-tokens and
tokens; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame

from funnelwise.llm.common import ids_and_texts, map_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_SCORE = -20.0
_KEPT = 1_000_000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """piece -> score of a sentencepiece vocabulary file, read by the driver (a fixed, small size)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(rank + 2) - 2.0 for rank, p in enumerate(ranked)}


class Counter:
    """Token counts of pre-tokens; finished ones are kept up to a bound."""

    def __init__(self, pieces: dict[str, float], kept: int = _KEPT):
        self.ends: dict = {}  # pieces by their characters from the last to the first; "" holds the score
        for piece, score in pieces.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.counts: dict[str, int] = {}
        self.kept = kept

    def learn(self, words: set[str]) -> None:
        """Count the pre-tokens not yet known, sharing forward scores along prefixes."""
        new = sorted(w for w in words if w not in self.counts)
        if len(self.counts) + len(new) > self.kept:
            self.counts = {w: n for w, n in self.counts.items() if w in words}
        ends, before = self.ends, ""
        best, used = [0.0], [0]  # of each prefix: score, tokens
        for word in new:
            text = MARK + word
            shared = 0
            for a, b in zip(text, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], used[shared + 1:]
            for d in range(shared, len(text)):
                size = len(text[d].encode("utf-8", "surrogatepass"))
                top, tokens = best[d] + BYTE_SCORE * size, used[d] + size
                node, start = ends, d
                while start >= 0:
                    node = node.get(text[start])
                    if node is None:
                        break
                    score = node.get("")
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and used[start] < tokens:
                            top, tokens = score, used[start] + 1
                    start -= 1
                best.append(top)
                used.append(tokens)
            self.counts[word] = used[-1]
            before = text


_BLANKS = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def pre_tokens(text: str) -> list[str]:
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens of every row."""
    held = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def setup():
        counter = Counter(held.value)

        def run(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            chars, many, tokens = [], [], []
            for i in range(0, len(texts), 256):
                part = [pre_tokens(t) for t in texts[i:i + 256]]
                counter.learn(set().union(*part))
                count = counter.counts.__getitem__
                many += [len(words) for words in part]
                tokens += [sum(map(count, words)) for words in part]
            chars = [len(t) for t in texts]
            return {"doc_id": batch.column(0), "n_chars": chars, "n_pretokens": many, "n_tokens": tokens}

        return run

    return map_batches(ids_and_texts(docs), setup, "doc_id bigint, n_chars bigint, n_pretokens bigint, n_tokens bigint", per_task=True)
