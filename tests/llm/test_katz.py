import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from funnelwise.llm import katz as K
from tests.llm.helpers import docs_frame, edge_rows, prose, spaced


def discounts(of):
    n = lambda r: of.get(r, 0)
    out = {}
    for r in range(1, K.CUT + 1):
        out[r] = 1.0
        if n(1) and n(r) and (K.CUT + 1) * n(K.CUT + 1) < n(1):
            tail = (K.CUT + 1) * n(K.CUT + 1) / n(1)
            d = ((r + 1) * n(r + 1) / n(r) / r - tail) / (1 - tail)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


class Brute:
    """The model by dictionaries over all texts."""

    def __init__(self, rows, contexts):
        self.train = [spaced(t) + [None] for i, t in rows if not held(i)]
        self.single, self.pair = Counter(), Counter()
        for tokens in self.train:
            self.single.update(tokens)
        ranked = sorted(self.single, key=lambda w: (-self.single[w], K.END if w is None else K.word_code(w.encode())))
        bins = Counter(step(n) for w, n in self.single.items())
        least, kept = 0, 0
        for b in sorted(bins, reverse=True):
            if kept + bins[b] >= contexts:
                least = b + 1
                break
            kept += bins[b]
        self.named = {w for w in ranked if w is None or step(self.single[w]) >= least}
        for tokens in self.train:
            self.pair.update(zip([self.context(h) for h in ["<begin>", *tokens[:-1]]], tokens))
        self.n = sum(self.single.values())
        self.d1, self.d2 = discounts(Counter(self.single.values())), discounts(Counter(self.pair.values()))
        self.after = defaultdict(dict)
        for (h, w), c in self.pair.items():
            self.after[h][w] = c

    def context(self, h):
        return h if h == "<begin>" or h in self.named else "<other>"

    def one(self, w):
        c = self.single.get(w, 0)
        if c:
            return self.d1.get(c, 1.0) * c / (self.n + 1)
        return 1 - sum(self.one(x) for x in self.single)

    def p(self, h, w):
        h = self.context(h)
        seen = self.after[h]
        total = sum(seen.values()) + 1
        if w in seen:
            return self.d2.get(seen[w], 1.0) * seen[w] / total
        left = 1 - sum(self.d2.get(c, 1.0) * c / total for c in seen.values())
        return left / (1 - sum(self.one(x) for x in seen)) * self.one(w)

    def row(self, i, text):
        tokens = spaced(text) + [None]
        v = len(self.single)
        return (i, held(i), len(tokens), sum(t in self.single for t in tokens), self.n, sum(log10((self.single.get(t, 0) + 1) / (self.n + v + 1)) for t in tokens),
                sum(log10(self.p(h, w)) for h, w in zip(["<begin>", *tokens], tokens)))


def step(n):
    return n if n <= K.CUT + 1 else int(np.floor(np.log2(n) * 64)) + 1000


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5]
        assert tuple(g)[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("contexts,dense,batch", [(65_534, 1_022, 1_000_000), (40, 10, 300), (12, 3, 1)])
def test_against_brute_force(spark, monkeypatch, contexts, dense, batch):
    monkeypatch.setattr(K, "DENSE", dense)
    monkeypatch.setattr(K, "BATCH_TOKENS", batch)
    monkeypatch.setattr(K, "FLUSH_TOKENS", batch)
    rows = [r for r in edge_rows(n=90) if r[0] != 110]
    model = Brute(rows, contexts)
    got = K.score_texts(docs_frame(spark, rows, extra=True), contexts=contexts).collect()
    same(got, [model.row(i, t) for i, t in rows])
    assert any(r.held_out and r.n_known < r.n_tokens for r in got)


@pytest.mark.parametrize("hot,dense,batch", [(40, 10, 300), (12, 3, 1), (1, 1, 2_000)])
def test_rare_histories_are_no_class(spark, monkeypatch, hot, dense, batch):
    """Every token has a history of its own, however few are broadcast."""
    monkeypatch.setattr(K, "DENSE", dense)
    monkeypatch.setattr(K, "BATCH_TOKENS", batch)
    rows = [r for r in edge_rows(n=90) if r[0] != 110]
    model = Brute(rows, 1 << 60)
    got = K.score_texts(docs_frame(spark, rows, extra=True), hot=hot).collect()
    same(got, [model.row(i, t) for i, t in rows])


def test_pairs_go_out_once_a_batch():
    """Equal pairs stand together in the order that is sent; a hot one is one key."""
    rng = np.random.default_rng(5)
    token = np.where(rng.random(5_000) < 0.4, 17 | 1 << 62, rng.integers(0, 60, 5_000))
    history = np.where(token >= 1 << 62, 99 | 1 << 62, np.where(rng.random(5_000) < 0.2, rng.integers(0, 4, 5_000) | 1 << 62, -1))
    context = np.where(history >= 0, 61, rng.integers(0, 20, 5_000))
    rare = token >= 1 << 62
    bucket = K.bucket_of(token, 16)
    order, new = K.key_runs(bucket, rare, token, context, history, 16)
    assert sorted(order.tolist()) == list(range(5_000))
    assert new.sum() == len(set(zip(token.tolist(), context.tolist(), history.tolist())))
    assert (np.diff(bucket[order] * 2 + rare[order]) >= 0).all()
    same_key = ~new[1:]
    assert (np.diff(order)[same_key] > 0).all()  # documents stay in order inside a key
    none = np.empty(0, np.int64)
    assert [len(x) for x in K.key_runs(none, none.astype(bool), none, none, none, 16)] == [0, 0]


def test_passage_in_most_documents(spark, monkeypatch):
    """A long passage of rare words that two thirds of the documents repeat."""
    monkeypatch.setattr(K, "DENSE", 5)
    monkeypatch.setattr(K, "BATCH_TOKENS", 4_000)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(150))
    rows = [(i, f"{prose(rng, 12)} {passage if i % 3 else ''} {prose(rng, 12)}") for i in range(120)]
    model = Brute(rows, 1 << 60)
    same(K.score_texts(docs_frame(spark, rows), hot=20).collect(), [model.row(i, t) for i, t in rows])


def test_groups_of_context_sums_stay_small():
    assert K.parts_of(16) == 64
    assert all(-(-n // K.parts_of(n)) <= 65 for n in (100, 4_096, 10 ** 7))
    assert -1 - K.parts_of(10 ** 9) > K.HISTORIES  # the targets don't overlap


def test_contexts_add_up_to_one():
    rng = random.Random(1)
    rows = [(i, prose(rng, 30, 60)) for i in range(60)]
    model = Brute(rows, 20)
    events = [*model.single, "never seen"]
    for h in ["<begin>", "<other>", *list(model.named)[:10]]:
        if h is not None:
            assert sum(model.p(h, w) for w in events) == pytest.approx(1)
    assert sum(model.one(w) for w in events) == pytest.approx(1)


def test_nothing_to_learn_and_empty(spark):
    rows = [(i, "a b") for i in range(200) if held(i)][:3] + [(i, None) for i in range(200) if held(i)][3:4]
    got = K.score_texts(docs_frame(spark, rows)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 4
    assert all(r.score == 0.0 for r in got)
    assert K.score_texts(docs_frame(spark, rows).limit(0)).count() == 0


def test_better_than_base_on_held_out_texts(spark):
    got = K.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_packed_integers():
    for x in ([], [0], [255], [256, 1], [1 << 40], [(1 << 62) - 1, 5]):
        assert K.unpack_ints(K.pack_ints(np.array(x, np.int64))).tolist() == x
    assert K.unsteps(K.steps(np.array([0, 0, 3, 9]))).tolist() == [0, 0, 3, 9]
