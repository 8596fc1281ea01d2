import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from funnelwise.llm import merkle as M
from tests.llm.helpers import docs_frame, edge_rows


def test_next_documents_and_edits(spark):
    rows = [r for r in edge_rows(n=95) if r[0] is not None and r[0] != 101] + [(101, "the only 101")]
    got = {r.doc_id: r for r in M.fingerprints(docs_frame(spark, rows, extra=True)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    for (i, text), (j, following) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        new = text[:len(text) - third] + following[:third]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (M.fingerprint(text), M.fingerprint(new))
        assert r.near_edited == M.likeness(M.fingerprint(text), M.fingerprint(new))
        assert r.near_next == M.likeness(M.fingerprint(text), M.fingerprint(following))


def test_repeated_ids_null_ids_one_row_and_none(spark):
    rows = edge_rows()
    got = M.fingerprints(docs_frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.fingerprint) for r in got], key=repr) == sorted([(i, M.fingerprint(t or "")) for i, t in rows], key=repr)
    one = M.fingerprints(docs_frame(spark, [(None, "alone with itself")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert M.fingerprints(docs_frame(spark, rows).limit(0)).count() == 0
    same = M.fingerprints(docs_frame(spark, [(1, "x y z"), (1, "x y z")])).collect()
    assert len(same) == 2 and same[0] == same[1]


def test_ranges_of_null_and_repeated_ids(spark):
    """Half of all rows have a null id, a quarter one id: they are spread over ranges, in order."""
    rows = [(None, f"null {i}") for i in range(2000)] + [(7, f"seven {i}") for i in range(1000)] + [(i, f"text {i}") for i in range(1000)]
    docs = docs_frame(spark, rows)
    placed = [r for r in M.with_next(docs).collect() if not r.extra]
    assert len(placed) == len(rows)
    sizes = Counter(r.range_no for r in placed)
    assert max(sizes.values()) < 400
    first, last = {}, {}
    for r in placed:
        first[r.range_no] = min(first.get(r.range_no, (2, 0)), (r.doc_id is None, -(r.doc_id or 0)))
        last[r.range_no] = max(last.get(r.range_no, (-1, 0)), (r.doc_id is None, -(r.doc_id or 0)))
    order = sorted(sizes)
    assert all(last[a] <= first[b] for a, b in zip(order, order[1:]))
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -keys[r[1]]))
    texts = [t for _, t in want]
    following = dict(zip(texts, texts[1:] + texts[:1]))
    got = M.fingerprints(docs).collect()
    hashes = Counter(hashlib.sha256(M.edited(t, following[t]).encode()).hexdigest() for t in texts)
    assert Counter(r.edited_sha256 for r in got) == hashes


def test_equality_likeness_and_location():
    rng = random.Random(1)
    words = lambda n: " ".join(f"u{rng.randrange(10_000)}" for _ in range(n))
    text = "\n\n".join("\n".join(words(40) for _ in range(3)) for _ in range(4))
    parts = text.split(" ")
    parts[200] = "edited"
    new = " ".join(parts)
    a, b = M.fingerprint(text), M.fingerprint(new)
    assert a[:32] != b[:32] and M.fingerprint(text) == a
    assert 0.9 < M.likeness(a, b) < 1
    assert M.likeness(a, M.fingerprint(words(400))) < 0.05
    places = M.differences(a, b)
    assert len(places) == 1
    section, paragraph = places[0]
    assert "edited" in new.split("\n\n")[section].split("\n")[paragraph]
    assert M.likeness(M.fingerprint(words(20_000)), M.fingerprint(text.join("ab"))) < 0.0005
    for x, y in (("", " "), ("a", "a\n"), ("a\n\nb", "a\n\n\nb"), ("a b", "a  b"), ("\n", "\n\n")):
        assert M.fingerprint(x)[:32] != M.fingerprint(y)[:32]
    assert M.likeness(M.fingerprint(""), M.fingerprint("")) == 1.0 and M.likeness(M.fingerprint(""), a) == 0.0


def test_mean_likeness_of_edited_and_next(spark):
    got = M.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    edited = [r.near_edited for r in got]
    assert sum(edited) / len(edited) > 0.6
    assert sum(r.near_edited > r.near_next for r in got if r.n_chars > 200) > 0.9 * sum(r.n_chars > 200 for r in got)
