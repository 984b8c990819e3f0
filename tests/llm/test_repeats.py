"""Suffix order against sorting; removal against every window of every text."""

import hashlib
import random

import pytest

from seriesloom.llm.repeats import LENGTH, cut_repeats
from seriesloom.llm.suffixes import suffix_order


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(2000):
        s = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        s *= rng.choice([1, 1, 2, 5])
        assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_order([]) == [] and suffix_order(b"a" * 3000) == list(range(2999, -1, -1))


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - LENGTH + 1):
                w = b[k : k + LENGTH]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - LENGTH + 1) if i is not None else ():
            if first[b[k : k + LENGTH]] < i:
                gone[k : k + LENGTH] = [True] * LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    parts = [text(rng.randint(20, 200)) for _ in range(12)] + ["z" * 120, "ab" * 60]
    rows = [(None, parts[0]), (0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 51)]
    for i in range(5, 90):
        t = "".join(rng.choice(parts) if rng.random() < 0.6 else text(rng.randint(1, 60)) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "q" + t[k + 1 :]
        rows.append((i, t))
    return rows + [(7, rows[10][1]), (9, rows[12][1] + "more"), rows[20], rows[20], (200, text(3000)), (-5, parts[3])]


@pytest.mark.parametrize("crowded", [16_384, 3])
def test_removal(spark, crowded):
    rows = make(crowded)
    random.Random(9).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    cut = cut_repeats(docs, crowded)
    assert digest(cut) == brute(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_bytes - len(r.kept) for r in cut.collect())


def test_unique_ids(spark):
    rows = list(dict(r for r in make(1) if r[0] is not None).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(cut_repeats(docs)) == brute(rows)


def test_empty(spark):
    assert cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
