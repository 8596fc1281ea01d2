"""Small tables and plain definitions that the operators are tested against."""

import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def alnum(text):
    return ALNUM.findall((text or "").translate(_LOWER))


def spaced(text):
    return SPACE.findall((text or "").translate(_LOWER))


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_frame(spark, rows, extra=False):
    """documents from (doc_id, text); with ``extra``, columns whose names the operators use."""
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    return spark.createDataFrame([(*r, 1, "x", 0.5, "y") for r in full], DOCS + ", n_words int, node string, score double, bucket string")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}{rng.choice('abc')}" for _ in range(n))


def edge_rows(seed=3, n=40):
    """Null, empty and blank texts, repeated rows, ties, a long text, a null id, copies."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(n)]
    base = prose(rng, 80)
    rows += [(100, base), (101, base), (101, base), (102, base.upper() + " "), (103, base.replace("w1a", "zz", 1)), (104, None), (105, ""), (106, " \n\t "),
             (107, "one"), (108, "One"), (109, "é ü x 漢字 naïve"), (None, prose(rng, 20)), (None, base), (110, prose(rng, 20_000)), (111, "a\n\nb\n\n\nc")]
    return rows
