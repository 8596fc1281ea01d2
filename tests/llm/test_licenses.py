import random
from collections import Counter

from funnelwise.llm import licenses as L
from tests.llm.helpers import alnum, docs_frame, edge_rows, prose

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words, starts, labels = alnum(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def rows():
    rng = random.Random(8)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "under the mit", "cc by cc by nc nc",
             "the mit license under the mit license under the mit license", "GNU General Public License, version 3.", "All rights reserved.", L.NOTICES[0][1], L.NOTICES[1][1]]
    out = edge_rows()
    for n in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(lines), prose(rng, rng.randint(0, 30))]
        out.append((400 + n, "\n".join(parts)))
    return out


def test_base_against_brute_force(spark):
    docs = rows()
    got = L.scan(docs_frame(spark, docs, extra=True)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == sorted([(i, *brute(t)) for i, t in docs], key=repr)
    for r in got:
        labels, base = set(filter(None, r.labels.split(","))), set(filter(None, r.base_labels.split(",")))
        assert base <= labels and 0 <= r.score <= 1
        assert (r.score > 0) == bool(labels)
    assert L.scan(docs_frame(spark, docs).limit(0)).count() == 0


def notice(label):
    return next(text for l, text, _ in L.NOTICES if l == label)


def every_place(text):
    """Labels by trying every template at every place of the text."""
    words, labels = alnum(text), set()
    for phrase, label in {**L.BASE, **L.PHRASES}.items():
        p = phrase.split()
        if any(words[i:i + len(p)] == p for i in range(len(words))):
            labels.add(label)
    for label, body, keys in L.NOTICES:
        want = alnum(body)
        for a in range(-len(want), len(words)):
            near = words[max(0, a - L.DRIFT):max(0, a + len(want) + 2 * L.DRIFT)]
            line = f" {' '.join(near)} "
            if all(f" {k} " in line for k in keys) and (Counter(near) & Counter(want)).total() >= L.COVERAGE * len(want):
                labels.add(label)
                break
    return ",".join(sorted(labels))


def test_labels_against_every_template_at_every_place(spark):
    """Notices whole, with words left out, replaced and put in, several in a text, among prose of their own words."""
    rng = random.Random(11)
    common = sorted({w for _, body, _ in L.NOTICES for w in alnum(body)})
    docs = [(i, L.NOTICES[i][1]) for i in range(len(L.NOTICES))]
    for i in range(100, 260):
        parts = [" ".join(rng.choice(common) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 1 + (i >= 200))):
            words = rng.choice(L.NOTICES)[1].split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(words))
                words[k:k + 1] = rng.choice([[], ["other"], [words[k], "more"]])
            parts += [" ".join(words), prose(rng, rng.randint(0, 20))]
        docs.append((i, "\n".join(parts)))
    got = {r.doc_id: r.labels for r in L.scan(docs_frame(spark, docs)).collect()}
    want = {i: every_place(t) for i, t in docs}
    assert {i: g for i, g in got.items() if i < 200} == {i: w for i, w in want.items() if i < 200}
    # with two notices, a window over both may hold a third one's phrases, for which no start agrees
    assert all(set(got[i].split(",")) <= {"", *want[i].split(",")} for i in want)
    assert sum(got[i] == want[i] for i in want if i >= 200) >= 55
    assert all(L.NOTICES[i][0] in got[i].split(",") for i in range(len(L.NOTICES)))


def test_notices_and_key_phrases(spark):
    mit, keys = L.NOTICES[0][1], L.NOTICES[0][2]
    cut = mit.replace("without restriction", "with restriction")
    near = mit.replace("associated documentation files", "its documentation").replace("publish, ", "")
    docs = [(1, "code\n" + mit), (2, cut), (3, near), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "All rights reserved."),
            (6, "permission is granted"), (7, mit + "\n" + notice("bsd"))]
    got = {r.doc_id: r for r in L.scan(docs_frame(spark, docs)).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["mit", "", "mit", "gpl-3", "all-rights-reserved", "", "bsd,mit"]
    assert got[1].score > got[3].score >= L.COVERAGE
