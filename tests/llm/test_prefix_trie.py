import hashlib
import random
import re
import zlib

import pytest

from funnelwise.llm import prefix_trie as P

DDL = "conv_id bigint, turn bigint, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(seqs):
    """Rows of the contract for conv_id -> list of (role, text)."""
    members, ends = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        gain = (len(members[node]) - 1) * len(SPACE.findall(node[-1][1])) if node else 0
        below = [sums[k] for k in kids.get(node, [])]
        sums[node] = (sum(b[0] for b in below) if below else 1, gain + sum(b[1] for b in below))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), *sums[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items())


def sequences(rows):
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(rows):
    own = sequences(rows)
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + s[h:]
    return out


def some_rows(seed=1, convs=90):
    rng = random.Random(seed)
    said = ["hello", "hello  there you", "", None, "a b c d", "x" * 3000, "é ü 漢字", " \n "]
    rows = []
    for c in rng.sample(range(-30, 300), convs):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if t or rng.random() < 0.7 else None, rng.choice(["user", "assistant", None]) if t > 1 else "user", rng.choice(said[:4] if t < 3 else said)))
    rows += [(None, 0, "user", "lost"), (2**62, 0, "user", "hello")]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("units,rows_,segment", [(4096, 65536, 16384), (7, 65536, 16384), (5, 12, 2)])
def test_against_brute_force(spark, monkeypatch, units, rows_, segment):
    # small shards, and conversations cut into pieces of two turns
    monkeypatch.setattr(P, "UNITS", units)
    monkeypatch.setattr(P, "ROWS", rows_)
    monkeypatch.setattr(P, "SEGMENT", segment)
    rows = some_rows()
    df = spark.createDataFrame([(*r, 5, b"z") for r in rows], DDL + ", n int, node binary").repartition(5)
    assert got(P.report(df)) == brute(rebuilt(rows))
    assert got(P.trie(*P.plain(df)).drop("node", "parent")) == brute(sequences(rows))


def test_one_long_conversation_is_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 16)
    rows = [(20, t, "user", f"w{t} v") for t in range(400)] + [(c, t, "user", f"w{t} v") for c in range(21, 27) for t in range(c * 3)]
    df = spark.createDataFrame(rows, DDL)
    assert got(P.report(df)) == brute(rebuilt(rows))
    sizes, turns = P.plain(df)
    zero = turns.withColumn("segment", (turns.pos / 16).cast("bigint"))
    starts = P._starts(zero)
    assert starts.count() == sum((n - 1 + 1) // 16 for n in [400] + [c * 3 for c in range(21, 27)])


def test_ties_and_repeated_rows_give_one_result(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (21, 0, "user", "b"), (21, 0, "user", "a"), (21, 0, "user", "b")]
    a, b = (got(P.trie(*P.plain(spark.createDataFrame(r, DDL).repartition(3))).drop("node", "parent")) for r in (rows, rows[::-1]))
    assert a == b
    assert [r[3] for r in a] == [2, 2, 2, 2]  # both conversations hold the same turns, so they share one path


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], DDL)).count() == 0


def test_turnless_conversation_ends_at_the_root(spark):
    # 26 takes three turns from conversation 20, which isn't there, and has none of its own after them
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    out = got(P.report(spark.createDataFrame([(c, 0, "user", "hi there")], DDL)))
    assert out == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
