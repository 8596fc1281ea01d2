import math
import random
import zlib
from collections import Counter

import numpy as np

from funnelwise.llm import language as L
from tests.llm.helpers import docs_frame

SYLLABLES = {"aa": ["ba", "lo", "min", "ter"], "bb": ["che", "uss", "pf", "ung"], "cc": ["ció", "ñar", "do", "que"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, seed=1, n=240):
    rng = random.Random(seed)
    rows = [(i, lang, sentence(rng, lang, rng.randint(4, 60))) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [(1000, "aa", None), (1001, "aa", ""), (1002, "bb", " 12 34 !?"), (1003, None, sentence(rng, "bb", 30)), (None, "cc", sentence(rng, "cc", 30)),
             (1004, "cc", sentence(rng, "cc", 300_000)), (1005, "aa", "ba"), (1005, "aa", "ba"), (1006, None, "漢字"), (1007, "bb", "…—")]
    return rows, spark.createDataFrame([(i, t, lang, "s", 0, 0.5, "q") for i, lang, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, gram string")


def test_held_out_languages(spark):
    rows, df = documents(spark)
    got = L.classify(df.repartition(3)).collect()
    assert len(got) == len(rows)
    want = {i: (lang, t) for i, lang, t in rows}
    for r in got:
        lang, text = want[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (1000, 1001, 1002, 1007):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, False)
        elif r.doc_id != 1006 and lang:
            assert r.lang_pred == lang, r
        elif r.doc_id == 1003:
            assert r.lang_pred == "bb"
        assert 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc", "und")
    strange = next(r for r in got if r.doc_id == 1006)
    assert strange.rejected and strange.score < 0.5  # far from every centroid


def test_labels_and_ids_are_no_inputs(spark):
    _, df = documents(spark)
    model = L.train(df, (df.doc_id % 2) == 0)
    a = L.identify(df, model).collect()
    b = L.identify(df.selectExpr("doc_id", "text", "'zz' as lang", "'x' as source"), model).collect()
    assert a == b


def grams(text):
    """n-grams by the plain definition."""
    raw = bytes(L._LETTER[list(text)]) if text else b""
    words = raw.split(b" ")
    line = b" " + b" ".join(w for w in words if w) + b" "
    if line == b"  ":
        line = b" "
    out = Counter()
    for size in L.SIZES:
        for i in range(len(line) - size + 1):
            code = size
            for c in line[i:i + size]:
                code = (code * 257 + c) % 2**64
            out[(code * 0x9E3779B97F4A7C15) % 2**64 >> (64 - L.BITS)] += 1
    return out


def test_grams_of_whole_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    for piece in (7, 64, 1 << 20):
        monkeypatch.setattr(L, "_PIECE", piece)
        for n in (0, 1, 3, 6, 7, 8, 14, 63, 64, 65, 200):
            text = "".join(rng.choice("abC d.  é\n") for _ in range(n)).encode()
            index, counts = L.gram_counts(text)
            assert dict(zip(index.tolist(), counts.tolist())) == grams(text), (piece, text)


def test_nearest_centroid_by_plain_cosine(spark):
    _, df = documents(spark, 3, 60)
    model = L.train(df, df.doc_id.isNotNull())
    text = sentence(random.Random(9), "bb", 20).encode()
    counts = grams(text)
    dense = np.zeros(1 << L.BITS)
    for g, c in counts.items():
        dense[g] = math.log1p(c) * model.idf[g]
    cosine = dense / np.linalg.norm(dense) @ model.centroids
    lang, score, _ = L.predict(model.plain(), text)
    assert lang == model.languages[model.owner[cosine.argmax()]] and 0 < score <= 1
    assert len(model.owner) > len(model.languages)  # several centroids per language
    assert np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-4)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "some text")])
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r.lang_pred for r in L.classify(nothing).collect()] == ["und"]
    assert L.classify(docs.limit(0)).count() == 0
