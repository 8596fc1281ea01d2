import random

from funnelwise.llm import token_counts as T
from tests.llm.helpers import docs_frame, edge_rows, prose, spaced


def brute(pieces, word):
    """Fewest tokens of a best segmentation, by trying every piece at every place."""
    text = T.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        size = len(text[i].encode())
        options = [(i + 1, T.BYTE_SCORE * size, size)] + [(j, pieces[text[i:j]], 1) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces]
        for j, s, n in options:
            new = (best[i][0] + s, best[i][1] + n)
            if best[j] is None or new[0] > best[j][0] or new[0] == best[j][0] and new[1] < best[j][1]:
                best[j] = new
    return best[-1][1]


def test_against_plain_dynamic_programming():
    pieces = T.load_pieces()
    rng = random.Random(1)
    words = [prose(rng, 1) for _ in range(50)] + ["hello", "tokenization", "internationalisation", "hell", "help", "naïve", "漢字", "x" * 300, "a", "🙂ok", "ünï"]
    words += ["".join(rng.choice("aeinst") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    counter = T.Counter(pieces, kept=60)
    for i in range(0, len(words), 40):
        counter.learn(set(words[i:i + 40]))
        for w in words[i:i + 40]:
            assert counter.counts[w] == brute(pieces, w), w


def test_counts_per_document(spark):
    rows = [r for r in edge_rows() if r[0] != 110]
    pieces = T.load_pieces()
    got = sorted([tuple(r) for r in T.count_tokens(docs_frame(spark, rows, extra=True)).collect()], key=repr)
    want = []
    for i, t in rows:
        words = T.pre_tokens(t or "")
        assert [w.lower() for w in words] == [w.lower() for w in spaced(t)]
        want.append((i, len(t or ""), len(words), sum(brute(pieces, w) for w in words)))
    assert got == sorted(want, key=repr)
    assert T.count_tokens(docs_frame(spark, rows).limit(0)).count() == 0
