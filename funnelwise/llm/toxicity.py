"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon comes from a bounded sample of labelled documents: words (and word
beginnings of 4 to 6 bytes, for inflected stems) that are far commoner in toxic
ones, with the log ratio as weight.  It is held as a trie.  A text's word is
matched by intersecting the trie with the Levenshtein automaton of the word, so
misspelled terms of 4 letters or more are found: one edit (in code points) away, with two
neighbouring letters swapped, or with digits written for letters.  Halves of
terms and a table of one-letter deletions keep words that can't match from the automaton.  Words that the
sample's other documents use are no misspellings (``ordinary``).  Matches of
fewer than ``SHORT`` letters, which are met by chance more often, have an input of their own.

Every hit is weighed in its context: inside quotation marks or after a reporting word it is a
quotation, which has an input of its own and adds to no other.  Sums over
the whole text and over the best window of ``WINDOW`` words go to a logistic
regression, fitted on a fold of the sample that the lexicon of its inputs hasn't seen.
Labelled texts hold few misspelled and hardly any quoted insults, so the fit also sees each
toxic row as if its terms were misspelled (still toxic), and as if they were quoted (not toxic), at
part of a row's weight.  No kind of hit may lower a score, and none may count more than an exact term.

Defined results: null and empty texts have no hits and get the model's score
for that; repeated rows get equal scores; other columns, labels, language,
source and id are no inputs; without toxic and clean labelled rows every score
is the share of toxic ones (0 without any label).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwise.llm.common import alnum_words, crc_mod, ids_and_texts, map_batches, staged, texts_of, unused
from funnelwise.llm.labelled import labelled_sample

MAX_ROWS = 40_000
MAX_TERMS = 4_096
LEAST_DOCS = 3
LEAST_WEIGHT = 2.0
#: Documents of the sample's others that make a word ordinary.
ORDINARY = 2
WINDOW = 16
THRESHOLD = 0.7
#: Words that introduce a quotation (fixed values).
REPORTING = frozenset(w.encode() for w in ("said", "says", "say", "wrote", "writes", "quote", "quoted", "quotes", "called", "calls", "term", "word",
                                           "insult", "slur", "reported", "sagte", "schrieb", "zitat", "dit", "écrit", "cité", "mot", "dijo", "escribió", "cita", "palabra"))
_PIECE = re.compile(rb'["\n]|\xe2\x80[\x9c\x9d\x9e]|\xc2[\xab\xbb]|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
_OPEN, _CLOSE, _BOTH = {b"\xe2\x80\x9e", b"\xc2\xab"}, {b"\xe2\x80\x9d", b"\xc2\xbb"}, {b'"', b"\xe2\x80\x9c"}
INPUTS = 10
_SEEN = (None, "misspelled", "quoted")
LEAST_LETTERS = 4
SHORT = 5
#: Weight of a toxic row seen as if misspelled, and as if quoted.
AS_MISSPELLED, AS_QUOTED = 0.5, 0.25
#: Letters that digits stand for (fixed values).
DIGITS = [str.maketrans("013457", "oieast"), str.maketrans("013457", "oleast")]


def stems(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in (4, 5, 6) if len(word) > n]


def letters(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1:] for i in range(len(word))}


def _halves(term: str) -> tuple[tuple[str, int], tuple[str, int]]:
    """The first and the last part of a term, each with the term's length: one edit leaves one of them whole."""
    n = len(term)
    return (term[:n // 2], n), (term[n // 2:], n)


class Lexicon:
    """Trie over weighted terms; terms that end in ``*`` are beginnings.

    ``ordinary``: words that are no misspellings.  ``loose`` also takes swapped neighbours and
    digits in place of letters.
    """

    def __init__(self, weights: dict[bytes, float], ordinary: frozenset[bytes] = frozenset(), loose: bool = False):
        self.exact = {t: w for t, w in weights.items() if not t.endswith(b"*")}
        self.begin = {t[:-1]: w for t, w in weights.items() if t.endswith(b"*")}
        self.ordinary, self.loose = ordinary, loose
        spelled = {letters(t): t for t in self.exact}
        spelled = {t: term for t, term in spelled.items() if len(t) >= LEAST_LETTERS}
        self.near = set(spelled).union(*map(deletions, spelled)) if spelled else set()
        self.starts, self.ends = {_halves(t)[0] for t in spelled}, {_halves(t)[1] for t in spelled}
        # a swap across the middle leaves neither half
        self.swapped = {t[:h - 1] + t[h] + t[h - 1] + t[h + 1:] for t in spelled for h in [len(t) // 2]} if loose else set()
        self.longest = max(map(len, spelled), default=-1) + 1  # of words that can match
        self.root: dict = {}
        for t, term in spelled.items():
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[-1] = term
        self.seen: dict[bytes, tuple[int, float] | None] = {}

    def misspelled(self, word: bytes, edits: int = 1) -> bytes | None:
        """The heaviest term within ``edits`` of ``word``: the trie is walked along with
        the automaton's states, kept as rows of edit distances."""
        word = letters(word)
        best, todo = None, [(self.root, list(range(len(word) + 1)), None, None)]
        while todo:
            node, row, above, letter = todo.pop()
            for c, child in node.items():
                if c == -1:
                    if row[-1] <= edits and (best is None or self.exact[child] > self.exact[best]):
                        best = child
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word):
                    step = min(new[i] + 1, row[i + 1] + 1, row[i] + (w != c))
                    if self.loose and above is not None and i and w == letter and word[i - 1] == c:
                        step = min(step, above[i - 1] + 1)  # two neighbours swapped
                    new.append(step)
                if min(new) <= edits or self.loose and min(row) < edits:
                    todo.append((child, new, row, c))
        return best

    def _one_edit(self, word: str) -> bool:
        """Whether a term may be one edit away: half of it is whole, and a deletion agrees."""
        m = len(word)
        for n in (m, m + 1, m - 1):
            if (word[:n // 2], n) in self.starts or (word[-(n - n // 2):], n) in self.ends:
                return word in self.near or not self.near.isdisjoint(deletions(word))
        return word in self.swapped

    def _find(self, word: bytes) -> bytes | None:
        """The term that ``word`` misspells, if any."""
        if word in self.ordinary:
            return None
        spelled = letters(word)
        if len(spelled) > self.longest:
            return None
        term = self.misspelled(word) if self._one_edit(spelled) else None
        if term is None and self.loose:
            if not word.isalpha() and any(x in word for x in b"013457") and not word.isdigit():
                for table in DIGITS:
                    plain = spelled.translate(table).encode("utf-8", "surrogateescape")
                    term = term or (plain if plain in self.exact and len(spelled) >= LEAST_LETTERS else None)
        return term

    def look_up(self, word: bytes) -> tuple[int, float] | None:
        """(kind, weight): kind 0 a term, 1 a beginning, 2 a misspelled term, 3 one where word or term is short."""
        try:
            return self.seen[word]
        except KeyError:
            pass
        hit = None
        if word in self.exact:
            hit = (0, self.exact[word])
        else:
            w = max((self.begin[word[:n]] for n in (4, 5, 6) if len(word) > n and word[:n] in self.begin), default=None)
            if w is not None:
                hit = (1, w)
            else:
                term = self._find(word)
                if term is not None:
                    hit = (3 if min(len(letters(word)), len(letters(term))) < SHORT else 2, self.exact[term])
        if len(self.seen) >= 1_000_000:
            self.seen.clear()
        self.seen[word] = hit
        return hit


def _quoted(text: bytes) -> list[bool]:
    """Of each word: whether it stands in quotation marks (which end with the line)."""
    out, inside = [], False
    for m in _PIECE.finditer(text.lower()):
        piece = m[0]
        if piece in _BOTH:
            inside = not inside
        elif piece in _OPEN:
            inside = True
        elif piece in _CLOSE or piece == b"\n":
            inside = False
        else:
            out.append(inside)
    return out


def inputs(text: bytes | None, lexicon: Lexicon, as_if: str | None = None) -> list[float]:
    """The regression's inputs of a whole text; ``as_if`` all its terms were ``misspelled`` or ``quoted``."""
    words = alnum_words(text)
    look = lexicon.look_up
    hits = [(i, h) for i, h in enumerate(map(look, words)) if h]
    if not hits:
        return [1.0, *[0.0] * (INPUTS - 2), np.log1p(len(words)) / 5]
    quoted = _quoted(text) if any(q in text for q in (*_BOTH, *_OPEN)) else None
    sums, quotes, terms = [0.0] * 4, 0.0, set()
    at, weight = [], []
    for i, (kind, w) in hits:
        if as_if == "quoted" or (quoted and quoted[i]) or not REPORTING.isdisjoint(words[max(0, i - 3):i]):
            quotes += w
            continue
        if as_if == "misspelled" and kind == 0:
            kind = 3 if len(letters(words[i])) < SHORT else 2
        sums[kind] += w
        terms.add(words[i])
        at.append(i)
        weight.append(w)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    first = np.searchsorted(at, np.array(at) - WINDOW, "right")
    best = float((total[1:] - total[first]).max(initial=0.0))
    return [1.0, *(float(np.log1p(s)) for s in sums[:3]), float(np.log1p(quotes)), float(np.log1p(best)), float(np.log1p(len(terms))),
            10 * len(at) / len(words), float(np.log1p(sums[3])), np.log1p(len(words)) / 5]


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS) -> tuple[dict[bytes, float], frozenset[bytes]]:
    """Weighted terms by document counts in the toxic and the other rows of a sample, and
    words near them that the others use (``ordinary``)."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            terms = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
                                             names=["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, target in zip(texts_of(batch), batch.column(batch.schema.get_field_index("target")).to_pylist()):
                words = set(alnum_words(text))
                (toxic if target >= 0.5 else clean).update(words.union(*map(stems, words)))
                if len(toxic) + len(clean) > 500_000:
                    yield flush()
        yield flush()

    sizes = sample.agg(F.count(F.when(F.col("target") >= 0.5, 1)).alias("a"), F.count("*").alias("n")).first()
    a, b = sizes["a"], sizes["n"] - sizes["a"]
    if not a or not b:
        return {}, frozenset()
    counts = sample.select("text", "target").mapInArrow(count, "term binary, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = staged(counts, "words")
    weight = F.log((F.col("toxic") + 0.5) / (a + 1)) - F.log((F.col("clean") + 0.5) / (b + 1))
    best = (counts.filter(F.col("toxic") >= LEAST_DOCS).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
            .orderBy((F.col("toxic") * F.col("weight")).desc(), "term").limit(max_terms))  # the lexicon's stated size
    terms = {bytes(r["term"]): float(r["weight"]) for r in best.collect()}
    held = sample.sparkSession.sparkContext.broadcast(terms)  # at most max_terms terms

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(held.value, loose=True)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if (h := lexicon.look_up(w)) and h[0] > 1], pa.binary())], names=["term"])

    # the sample's words that a misspelling could be mistaken for: a part of a bounded sample's words
    used = counts.filter((F.col("clean") >= ORDINARY) & (weight < LEAST_WEIGHT)).select("term").mapInArrow(near, "term binary")
    return terms, frozenset(bytes(r["term"]) for r in used.collect())


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, low: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps (first column: ones, not shrunk); ``share``: weights of
    the rows; ``low``: least coefficients, at which those stay that would fall below."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    share = np.ones(len(y)) if share is None else share
    low = np.full(len(w), -np.inf) if low is None else low

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -500, 500)
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + shrink * w
        free = ~((w <= low) & (grad > 0))
        curve = (x[:, free] * (share * p * (1 - p) + 1e-9)[:, None]).T @ x[:, free] + np.diag(shrink[free])
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve, grad[free])
        size = 1.0
        while size > 1e-6 and loss(new := np.maximum(w - size * step, low)) > now:
            size /= 2
        if size <= 1e-6 or now - loss(new) < 1e-10:
            break
        w, now = new, loss(new)
    return w


class Model:
    def __init__(self, weights: dict[bytes, float], ordinary: frozenset[bytes], coefficients: np.ndarray):
        self.weights, self.ordinary, self.coefficients = weights, ordinary, coefficients


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, column: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled rows of those where ``learn`` (over doc_id) holds."""
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(docs, labels, column, learn, max_rows)
    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) == 0
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(learn_lexicon(sample.filter(~fold)))  # at most MAX_TERMS terms, and words near them in the sample

    def run(batch: pa.RecordBatch) -> dict:
        lexicon = Lexicon(*held.value, loose=True)
        return {"target": batch.column(2), "x": [[v for as_if in _SEEN for v in inputs(t, lexicon, as_if)] for t in texts_of(batch)]}

    table = map_batches(sample.filter(fold), run, "target double, x array<double>").toArrow()  # about max_rows / 3 rows at most
    got = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    y = np.array([float(t >= 0.5) for t, _ in got])
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model({}, frozenset(), np.array([np.log(share / (1 - share)), *[0.0] * (INPUTS - 1)]))
    x = np.array([x for _, x in got]).reshape(len(y), len(_SEEN), INPUTS)
    toxic = x[(y == 1) & (x[:, 0, 1] > 0)]  # rows with an exact term
    rows = np.concatenate([x[:, 0], toxic[:, 1], toxic[:, 2]])
    target = np.concatenate([y, np.ones(len(toxic)), np.zeros(len(toxic))])
    share = np.concatenate([np.ones(len(y)), np.full(len(toxic), AS_MISSPELLED), np.full(len(toxic), AS_QUOTED)])
    low = np.zeros(INPUTS)
    low[[0, INPUTS - 1]] = -np.inf  # the constant and the length
    w = logistic(rows, target, share, low)
    for k in (3, 4, 8):  # misspelled, quoted, short
        w[k] = min(w[k], w[1])
    return Model(*learn_lexicon(sample), w)


def scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row; with ``keep``, those columns and a last one with the score."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.ordinary, model.coefficients))  # as in train()

    def score(texts: list[bytes | None]) -> list[float]:
        lexicon, w = Lexicon(*held.value[:2], loose=True), held.value[2]
        return [float(1 / (1 + np.exp(-np.clip(np.dot(inputs(t, lexicon), w), -30, 30)))) for t in texts]

    if keep is None:
        return map_batches(ids_and_texts(docs), lambda b: {"doc_id": b.column(0), "score": score(texts_of(b))}, "doc_id bigint, score double")
    name = unused(docs, "score")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{name}` double"])
    return map_batches(docs, lambda b: {**{c: b.column(b.schema.get_field_index(c)) for c in keep}, name: score(texts_of(b))}, ddl)


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = train(docs, labels, crc_mod(F.col("doc_id"), folds) != held_out_fold)
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more; fitted on all labelled rows' sample."""
    model = train(docs, labels)
    scored = scores(docs, model, docs.columns)
    return scored.filter(F.col(scored.columns[-1]) < threshold).select(*docs.columns)
