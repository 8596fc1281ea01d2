import hashlib
import random

import numpy as np
import pytest

from funnelwise.llm import decontaminate as D
from tests.llm.helpers import alnum, docs_frame, edge_rows, prose


def brute(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        words, hit, found = alnum(text), set(), set()
        for item, t in items:
            w = alnum(t)
            k = min(window, len(w))
            for j in range(len(w) - k + 1) if k else []:
                for i in range(len(words) - k + 1):
                    if words[i:i + k] == w[j:j + k]:
                        hit.update(range(i, i + k))
                        found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    rows = [r for r in edge_rows() if r[0] != 110]
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (10, "w1a w2b!"), (3, None), (4, ""), (5, rows[3][1]), (5, rows[3][1]), (6, "x y z"), (None, "w3a w1b w1c"),
             (7, " ".join(["w1a"] * 25)), (8, "--W1A... w1a/w1a ")]
    for i in (5, 9, 9):
        rows.append((200 + i, prose(rng, 15) + "; " + items[0][1].upper()[3:] + " " + prose(rng, 5)))
    rows.append((300, " ".join(["w1a"] * 40)))
    return rows, items


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50}, {"block_bytes": 60}, {"shard_words": 7, "block_bytes": 1}])
def test_against_brute_force(spark, case, sizes):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_frame(spark, rows, extra=True)
    leaks = D.find_leaks(docs, bench, **sizes)
    want = brute(rows, items)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, len(set(r.item_ids)), hashlib.sha256(",".join(sorted(set(r.item_ids))).encode()).hexdigest(), r.n_hit > 0)
                  for r in leaks.collect()], key=repr)
    assert got == want
    kept = D.decontaminate(docs, bench, **sizes)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_report_columns_and_empty_tables(spark, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_frame(spark, rows)
    got = sorted([tuple(r) for r in D.report(docs, bench).collect()], key=repr)
    assert got == brute(rows, items)
    assert D.report(docs, bench).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert D.report(docs.limit(0), bench).count() == 0
    assert D.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_longest_match_and_place(spark):
    rng = random.Random(1)
    item = prose(rng, 40, 10_000)
    docs = docs_frame(spark, [(1, "zz yy " + " ".join(item.split()[3:29]) + " xx")])
    row = D.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).first()
    assert (row.longest_words, row.longest_item, row.longest_at, row.n_hit) == (26, "9", 2, 26)


def test_suffix_array_is_sorted():
    words = np.random.default_rng(0).integers(0, 4, 300).astype(np.int32)
    order = D.suffix_array(words, 300)
    assert sorted(order) == list(range(300))
    suffixes = [words[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)


def test_a_prompt_of_all_items_in_many_documents():
    # one shared 10-word prompt: the work is locations plus items, not their product
    import time
    import tracemalloc
    prompt = [f"p{i}".encode() for i in range(10)]
    rows = [(str(i), prompt + [f"q{i}".encode(), f"r{i % 7}".encode()]) for i in range(3_000)]
    items = D.Items(rows, 10)
    texts = [prompt + [f"q{i}".encode(), b"zz"] for i in range(3_000)]
    shard = [[items.vocabulary.get(w, 0) for w in t] for t in texts]
    tracemalloc.start()
    began = time.process_time()
    out = D._judge(shard, items, [None] * len(shard))
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 5 and most < 200e6
    assert all(o[0] == 12 and o[1] == 11 and len(o[3]) == 3_000 and o[4] == 11 and o[5] == str(i) and o[6] == 0 for i, o in enumerate(out))


def test_longest_match_against_all_suffixes():
    rng = random.Random(12)
    items = D.Items([(str(k), [rng.choice("abc").encode() for _ in range(rng.randint(2, 30))]) for k in range(25)], 4)
    text = [rng.choice("abc").encode() for _ in range(300)]
    codes = np.array([items.vocabulary[w] for w in text] + [0], np.int32)
    best = {}
    for s, size in zip(items.starts, np.repeat(items.windows, items.end - items.begin)):
        for i in range(len(text)):
            n = 0
            while codes[i + n] and codes[i + n] == items.words[s + n]:
                n += 1
            if n >= size:
                best[i, int(size)] = max(best.get((i, int(size)), 0), n)
    at, window, length, suffix = D.match_shard(codes, items)
    assert {(int(a), int(items.windows[w])): int(n) for a, w, n in zip(at, window, length)} == best
    for a, n, s in zip(at, length, suffix):
        assert codes[a:a + n].tolist() == items.words[items.starts[s]:items.starts[s] + n].tolist()


def test_state_columns_keep_clear_of_the_tables_own(spark, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_frame(spark, rows).selectExpr("*", "7 as n_hit", "'x' as item_ids", "3 as HIT_BITS")
    kept = D.decontaminate(docs, bench, block_bytes=60)
    assert kept.columns == docs.columns and {r.n_hit for r in kept.collect()} == {7}
    assert kept.count() == sum(not w[-1] for w in brute(rows, items))
