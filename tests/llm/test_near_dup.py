import random

import pytest

from funnelwise.llm import near_dup as N
from tests.llm.helpers import docs_frame, edge_rows, prose, spaced

RULE = N.Rule(3, 85, 6, 40)


def shingles(text, k):
    w = spaced(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, rule):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t, rule.shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc_id]
        label = min(group, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), label, doc_id == label))
    return sorted(out, key=repr)


def near_rows(seed=2):
    """Chains of edits, so that groups are joined through members that aren't alike, and
    texts that share a passage."""
    rng = random.Random(seed)
    rows, n = [], 500
    passage = prose(rng, 60, 5_000)
    for _ in range(12):
        words = prose(rng, rng.randint(30, 120), 5_000).split()
        for _ in range(rng.randint(1, 9)):
            rows.append((n, " ".join(words)))
            n += rng.randint(1, 3)
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
    rows += [(n + i, passage + " " + prose(rng, 40, 5_000)) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [RULE, N.Rule()])
def test_against_all_pairs(spark, rule):
    rows = edge_rows() + near_rows()
    got = sorted([tuple(r) for r in N.components(docs_frame(spark, rows, extra=True), rule).collect()], key=repr)
    assert got == brute(rows, rule)


def test_open_buckets_are_finished(spark, monkeypatch):
    # one weak band: unlike texts fall into one bucket, and the star alone can't join all groups
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = near_rows(7)
    rule = N.Rule(3, 85, 1, 64)
    got = sorted([tuple(r) for r in N.components(docs_frame(spark, rows), rule).collect()], key=repr)
    assert got == brute(rows, rule)


def test_lookup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "LOOKUP_KEYS", 0)
    rows = near_rows(9)
    assert sorted([tuple(r) for r in N.components(docs_frame(spark, rows), RULE).collect()], key=repr) == brute(rows, RULE)


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = edge_rows() + near_rows()
    rule = N.Rule()
    docs = docs_frame(spark, rows, extra=True)
    kept = N.deduplicate(docs, rule)
    assert kept.columns == docs.columns
    want = brute(rows, rule)
    groups = {w[2] for w in want if w[1]}
    nulls = {t for i, t in rows if i is None and all(w[2] is None for w in want if w[0] is None)}
    blank = sum(1 for _, t in rows if not spaced(t))
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(groups) + blank
    assert {i for i in got if i is not None} >= {g for g in groups if g is not None}


def test_empty_table(spark):
    docs = docs_frame(spark, [(1, "a")]).limit(0)
    assert N.components(docs, RULE).count() == 0
    assert N.deduplicate(docs, RULE).count() == 0


def test_connected(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.root for r in N.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node, root in got.items():
        todo, seen = [node], {node}
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert root == min(seen)
    assert set(got) == {x for x in near if near[x] != {x}}


def test_helper_columns_keep_the_tables_own(spark):
    rows = near_rows(3)[:30]
    docs = docs_frame(spark, rows).selectExpr("*", "99 as _doc_id", "'k' as text_key", "7 as id_number", "5 as keep_id", "6L as KEEP_KEY")
    kept = N.deduplicate(docs, N.Rule())
    assert kept.columns == docs.columns
    assert {tuple(r)[5:] for r in kept.collect()} == {(99, "k", 7, 5, 6)}


def test_blocks_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 300)
    rows = near_rows(11)
    rule = N.Rule(3, 85, 1, 64)
    assert sorted([tuple(r) for r in N.components(docs_frame(spark, rows), rule).collect()], key=repr) == brute(rows, rule)


def test_a_large_group_gives_few_links(spark):
    # near copies of one text, most of them not linked with each other: rows stay below members x blocks
    rng = random.Random(6)
    base = prose(rng, 120, 5_000).split()
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = docs_frame(spark, rows)
    g = N.group(docs, RULE)
    assert sorted([tuple(r) for r in N.components(docs, RULE).collect()], key=repr) == brute(rows, RULE)
    assert g.links is None or g.links.count() < 250 * (N.FIRST + RULE.bands)
