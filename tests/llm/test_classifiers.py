import random
import zlib

import numpy as np
import pytest

from funnelwise.llm import quality as Q, toxicity as T
from tests.llm.helpers import docs_frame, edge_rows, prose

SF = "/root/testdata/sf0.1"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        tied = score == s
        ranks[tied] = ranks[tied].mean()
    pos = label == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("module,column,fold,folds", [(Q, "quality", 2, 4), (T, "toxic", 1, 3)])
def test_held_out_accuracy(spark, module, column, fold, folds):
    got = module.classify(table(spark, "documents"), table(spark, "labels"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, "labels"), "doc_id").collect()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in rows if r.held_out]
    score, label = np.array([r.score for r in out]), np.array([r[column] for r in out])
    assert auc(score, label) > 0.95
    assert (np.array([r.predicted for r in out]) == label).mean() > 0.93


@pytest.mark.parametrize("module,column", [(Q, "quality"), (T, "toxic")])
def test_edge_rows_get_scores(spark, module, column):
    rng = random.Random(3)
    rows = edge_rows() + [(500 + i, prose(rng, 40) + (" idiot moron scum" if i % 2 else "")) for i in range(60)]
    labels = [(500 + i, 1 - i % 2, i % 2) for i in range(60)] + [(None, 1, 0), (501, None, None), (9999, 0, 1), (500, 1, 0)]
    docs = docs_frame(spark, rows, extra=True)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = module.classify(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[101]) == 1
    assert len(by_id[104] | by_id[105]) == 1
    assert module.classify(docs.limit(0), lab).count() == 0
    none = module.classify(docs, lab.limit(0)).collect()
    assert len(none) == len(rows) and len({r.predicted for r in none}) == 1
    keep = Q.keep_good if module is Q else T.keep_clean
    kept = keep(docs, lab)
    assert kept.columns == docs.columns


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    fm = Q.FactorisationMachine(np.zeros((len(Q.STATS), Q.BINS - 1)))
    fm.w = rng.normal(size=len(fm.w))
    index, value = rng.choice(len(fm.w), 12, replace=False), rng.normal(size=12)
    pairs = sum(fm.v[index[i]] @ fm.v[index[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    assert fm.raw(index, value) == pytest.approx(fm.w0 + fm.w[index] @ value + pairs)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_misspelled_terms_against_edit_distance():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))).encode(): rng.random() + 2 for _ in range(40)}
    lexicon = T.Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9))).encode()
        near = {t for t in terms if distance(t, word) <= 1}
        hit = lexicon.look_up(word)
        if word in terms:
            assert hit == (0, terms[word])
        elif near:
            assert hit == (2, max(terms[t] for t in near))
        else:
            assert hit is None


def test_quotation_counts_less():
    lexicon = T.Lexicon({b"scumbag": 5.0, b"lowei*": 4.0})
    plain, quoted, reported = (T.inputs(t.encode(), lexicon) for t in ("you are a scumbag here", 'he "is a scumbag" here', "the word scumbag is here"))
    assert quoted[1] < plain[1] and reported[1] < plain[1] and quoted[4] > 0 == plain[4]
    assert T.inputs("you are a scumbog here".encode(), lexicon)[3] > 0
    assert T.inputs("loweischaft".encode(), lexicon)[2] > 0
    assert T.inputs(None, lexicon)[1:8] == [0.0] * 7


def test_mixed_words_are_counted_over_the_whole_text():
    words = [b"junk%" if i % 3 == 0 else b"word" for i in range(1_700)] + [b"end.", b"\xc3\xa9t\xc3\xa9", b"a#"]
    text = b" \x0b\n".join(words)
    value = Q.words_and_stats(text, Q.Buckets())[2][Q.STATS.index("mixed_words")]
    assert value == sum(w[-1:] in b"%#" for w in words) / len(words)


def test_misspelled_short_and_accented_terms_against_edit_distance():
    lexicon = T.Lexicon({t.encode(): 3.0 for t in ("scum", "trash", "idiot", "stüpid")})
    for word in ("scam", "scums", "cum", "scúm", "tras", "rash", "dumb", "ídiot", "stupid", "stüpíd", "stúpid", "stu\u0308pid"):
        near = any(distance(t, word) <= 1 for t in ("scum", "trash", "idiot", "stüpid"))
        hit = lexicon.look_up(word.encode())
        assert (hit is not None) == near, word
        if hit:
            assert hit[0] == (3 if min(len(word), 4 if "c" in word else 5) < 5 else 2)
    assert T.inputs("you sclum".encode(), lexicon)[8] > 0


def test_misspelled_terms_of_four_letters_in_the_given_alphabet():
    rng = random.Random(8)
    terms = {"".join(rng.choice("abcé") for _ in range(rng.randint(3, 7))): rng.random() + 2 for _ in range(30)}
    lexicon = T.Lexicon({t.encode(): w for t, w in terms.items()})
    for _ in range(2000):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 8)))
        near = [w for t, w in terms.items() if len(t) >= 4 and distance(t, word) <= 1]
        hit = lexicon.look_up(word.encode())
        assert hit == ((0, terms[word]) if word in terms else hit and (hit[0], max(near))) and (hit is not None) == (word in terms or bool(near))


def swap_distance(a, b):
    """Edit distance in which two swapped neighbours are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            step = min(row[j] + 1, rows[i][j + 1] + 1, rows[i][j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                step = min(step, rows[i - 1][j - 1] + 1)
            row.append(step)
        rows.append(row)
    return rows[-1][-1]


def test_swapped_neighbours_and_digits():
    rng = random.Random(21)
    terms = {"".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))): rng.random() + 2 for _ in range(40)}
    lexicon = T.Lexicon({t.encode(): w for t, w in terms.items()}, frozenset([b"abcab"]), loose=True)
    for _ in range(3000):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(3, 9)))
        near = [w for t, w in terms.items() if swap_distance(t, word) <= 1]
        hit = lexicon.look_up(word.encode())
        if word in terms:
            assert hit == (0, terms[word])
        elif word == "abcab":
            assert hit is None
        else:
            assert (hit and hit[1]) == (max(near) if near else None), word
    insults = T.Lexicon({b"idiot": 5.0, b"loser": 4.0}, loose=True)
    assert [insults.look_up(w) for w in (b"idoit", b"1d10t", b"l0s3r", b"1053r")] == [(2, 5.0), (2, 5.0), (2, 4.0), (2, 4.0)]
    assert insults.look_up(b"10") is None and insults.look_up(b"") is None


def test_bounded_logistic():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3))], axis=1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 2, -1.5, 0])))).astype(float)
    free = T.logistic(x, y)
    p = 1 / (1 + np.exp(-x @ free))
    assert np.allclose(x.T @ (p - y) + np.array([1e-6, 1, 1, 1]) * free, 0, atol=1e-4)
    held = T.logistic(x, y, low=np.array([-np.inf, 0, 0, 0]))
    assert held[2] == 0 and held[1] > 0
    grad = x.T @ (1 / (1 + np.exp(-x @ held)) - y) + np.array([1e-6, 1, 1, 1]) * held
    assert grad[2] > 0 and abs(grad[[0, 1]]).max() < 1e-3
    assert np.allclose(T.logistic(x, y, np.full(400, 2.0), ridge=2.0), free, atol=1e-3)


def test_misspelled_insults_raise_a_score_and_quoted_ones_lower_it(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = T.train(spark_docs, labels)
    lexicon = T.Lexicon(model.weights, model.ordinary, loose=True)

    def score(text):
        return 1 / (1 + np.exp(-np.dot(T.inputs(text.encode(), lexicon), model.coefficients)))

    prose = "the weather was fine and they went out to see the old town with friends "
    for around in ("", prose):
        clean = score(around + "you are a friend and a helper " + around)
        exact = score(around + "you are an idiot and a moron " + around)
        for text in ("you are an id1ot and a mor0n ", "you are an idoit and a morno ", "you are an ídiot and a moroon "):
            assert clean < score(around + text + around) <= exact, text
        quoted = score(around + 'they "you are an idiot and a moron" ' + around)
        assert quoted < score(around + "you are an id1ot and a mor0n " + around) and quoted < exact
