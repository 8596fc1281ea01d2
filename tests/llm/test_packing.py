import random
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from funnelwise.llm import packing as P
from tests.llm.helpers import docs_frame, edge_rows, spaced


def check(rows, got, capacities):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.shard, r.bin].append(r)
        pieces[r.doc_id].append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: r.start)
        assert len({(r.capacity, r.used) for r in inside}) == 1
        at = 0
        for r in inside:
            assert r.start == at
            at += r.length
        assert at == inside[0].used
        assert inside[0].capacity == min(c for c in capacities if c >= at)
    want, have = defaultdict(int), defaultdict(int)
    for i, t in rows:
        want[i] += len(spaced(t)) + 1
    for r in got:
        have[r.doc_id] += r.length
    assert want == have


def test_every_word_is_packed_once(spark):
    rows = edge_rows()
    docs = docs_frame(spark, rows, extra=True)
    check(rows, P.pack_documents(docs).collect(), P.CAPACITIES)
    small = P.pack_documents(docs, (16, 32, 64), shard_rows=7).collect()
    assert len({r.shard for r in small}) > 1
    check(rows, small, (16, 32, 64))
    long = sorted((r.piece, r.first_word, r.length) for r in small if r.doc_id == 110)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(f == 64 * p for p, f, _ in long)
    assert P.pack_documents(docs.limit(0)).count() == 0


def plain(lengths, capacities, mix):
    """Each piece goes to the open bin with the least room that holds it, of several to the one filled
    last; [capacity opened, content] of the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            best = min(reversed(fits), key=lambda b: b[0] - b[1])
            bins = [b for b in bins if b is not best] + [best]
            best[1] += n
        else:
            bins.append([mix[next(k for k, c in enumerate(capacities) if c >= n)], n])
    return bins


def total(contents, capacities):
    return sum(P.cost(next(c for c in capacities if c >= n)) for n in contents)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_and_mixes_by_a_plain_search(lengths):
    """Every mix is packed as a plain search packs it, and the cheapest one is taken."""
    capacities = [16, 32, 64]
    mixes = [(a, b, 64) for a in capacities for b in (32, 64)]
    assert P.mixes(capacities) == mixes
    for mix in mixes:
        where, content = P.best_fit(sorted(lengths, reverse=True), capacities, mix)
        bins = plain(lengths, capacities, mix)
        assert sum(content) == sum(lengths) and len(content) == len(bins)
        assert sorted(content) == sorted(n for _, n in bins) and len(where) == len(lengths)
    where, capacity, content = P.pack(lengths, capacities)
    assert [sum(n for n, b in zip(lengths, where) if b == k) for k in range(len(content))] == content
    assert total(content, capacities) == min(total([n for _, n in plain(lengths, capacities, m)], capacities) for m in mixes)
    assert all(c >= n and (c == 16 or c // 2 < n) for c, n in zip(capacity, content))


def test_lengths_are_chosen_together():
    """Never dearer than one opening size for all, cheaper on mixed lengths."""
    rng = random.Random(5)
    tables = [[min(4096, int(rng.paretovariate(spread) * 60)) for _ in range(1500)] + [rng.randint(500, 1100) for _ in range(500)] for spread in (0.7, 1.3)]
    mixed = [rng.randint(1280, 1360) for _ in range(600)] + [rng.randint(960, 1020) for _ in range(600)]  # threes fit 4,096, ones 1,024
    for lengths in (*tables, mixed):
        falling = sorted(lengths, reverse=True)
        single = min(total(P.best_fit(falling, P.CAPACITIES, [max(c, k) for k in P.CAPACITIES])[1], P.CAPACITIES) for c in P.CAPACITIES)
        together = total(P.pack(lengths)[2], P.CAPACITIES)
        assert together <= single
    assert together < 0.97 * single


def test_little_room_is_wasted():
    rng = random.Random(2)
    lengths = [min(4096, int(rng.paretovariate(0.9) * 60)) for _ in range(5000)]
    _, capacity, content = P.pack(lengths)
    assert sum(content) > 0.97 * sum(capacity)
