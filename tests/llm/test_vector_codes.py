import hashlib
import math
import random

import pytest

from funnelwise.llm import vector_codes as V

DDL = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = next(len(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if v and len(v) % parts == 0)
    fits = [r for r in kept if len(r[1]) == dims]
    run = dims // parts
    first = sorted(fits, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[r[1][p * run:(p + 1) * run] for r in first] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in fits:
                part = v[p * run:(p + 1) * run]
                groups.setdefault(nearest(part, p)[1], []).append(part)
            for k, g in groups.items():
                book[p][k] = [sum(x) // len(g) for x in zip(*g)]
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        if len(v) != dims:
            out.append((i, lab, None, None))
            continue
        best = [nearest(v[p * run:(p + 1) * run], p) for p in range(parts)]
        error = sum(b[0] for b in best)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, lab, "".join(f"{b[1]:02x}" for b in best), error))
    return sorted(((i, c, e, by_label.get(lab), sha) for i, lab, c, e in out), key=repr)


def vectors(seed, n, dims=16, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(6)]
    return [(i * 3 + 5, [float(x + rng.gauss(0, 0.2 * scale)) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]


def as_float(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("block", [1 << 18, 40 * 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_VALUES", block)
    rows = vectors(1, 200)
    rows += [(1, None, 1), (2, [1.0] * 15 + [None], 1), (3, [float("nan")] * 16, 2), (4, [float("inf")] + [0.0] * 15, 2),
             (900, [0.5] * 16, 7), (900, [0.5] * 16, 7), (901, [0.0] * 8, None), (902, [], 1), (None, [0.25] * 16, None), (903, [-0.0] * 16, 1)]
    rows = as_float(rows)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], DDL + ", code string, error int").repartition(4)
    got = V.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)


def test_large_values_and_few_vectors(spark):
    # beyond what int64 sums of squares hold; fewer vectors than entries
    rows = as_float(vectors(3, 9, 8, 1e6))
    got = sorted([tuple(r) for r in V.compress(spark.createDataFrame(rows, DDL)).collect()], key=repr)
    want = [(*r[:2], min(r[2], 2**63 - 1), min(r[3], 2**63 - 1), r[4]) for r in brute(rows)]
    assert got == want
    huge = spark.createDataFrame([(i, [1e30 * (i + 1)] * 8, 1) for i in range(20)], DDL)
    assert V.compress(huge).count() == 20


def test_decoded_codes_are_near_their_vectors(spark):
    rows = as_float(vectors(5, 300))
    df = spark.createDataFrame(rows, DDL)
    kept = df.selectExpr("vec_id", "label", "cast(embedding as array<double>) vector")
    first = V.first_entries(kept, 8, 16, V.SCALE)
    stored = V.blocks(kept, 16, V.SCALE)
    book = V.train(stored, first)
    by_id = {i: v for i, v, _ in rows}
    for r in V.encode(stored, book, "int").collect():
        far = sum((4096 * a - math.floor(4096 * b)) ** 2 for a, b in zip(book.decode(r.code), by_id[r.vec_id]))
        assert round(far) == r.error


def test_empty_table_and_no_fitting_vector(spark):
    assert V.compress(spark.createDataFrame([], DDL)).count() == 0
    got = V.compress(spark.createDataFrame([(1, [0.5] * 5, 1), (2, [], 1)], DDL)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, None, None), (2, None, None)]
