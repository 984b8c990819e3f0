"""Collocations against a plain count over word sequences."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import phrases


def plain(rows, longest=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            covered |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= percent * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in covered:
            s, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "the", "Of", "é", "über", "ñandú", "|", "'x'", "日本", " ", "a-b"]
    fixed = ["the of the", "New york city", "über über über", "a b\tc d"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice([". ", ", ", "\n", "; ", "!?", "\x0b", " "]).join(parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \t", "xx"), ("one", "en"), ("A a a a a a a a a a a a a a", "zz")]


def found(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("longest", "top", "chunk", "bits"), [(3, 2000, 4 << 20, 16), (3, 25, 300, 16), (4, 2000, 900, 3), (2, 2000, 100, 16)])
def test_phrases(spark, monkeypatch, longest, top, chunk, bits):
    rows = texts(longest + top, 500)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    if bits < 16:  # a bitmap in which nearly all hashes meet costs nothing but work
        monkeypatch.setattr(phrases, "MOST_BITS", 15)
        monkeypatch.setattr(phrases, "LEAST_BITS", 15)
        monkeypatch.setattr(phrases.Bitmap, "has", lambda self, h: np.ones(len(h), bool))
    if chunk < 900:
        monkeypatch.setattr(phrases, "TOGETHER", 5)
    docs = spark.createDataFrame([(1, t, la, 7, "x") for t, la in rows], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    assert found(phrases.top_phrases(docs, longest=longest, top=top)) == plain(rows, longest, top=top)


def test_long_text_and_empty(spark):
    rows = [("lorem ipsum dolor, " * 300_000, "la"), ("word " * 200_000, "la")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(phrases.top_phrases(docs)) == plain(rows)
    assert phrases.top_phrases(docs.limit(0)).count() == 0
    assert phrases.top_phrases(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_cut_text():
    text = b"ab cd. efg hij\nklmnopqrstuvwxyz! a b c d"
    for most in range(1, 50):
        parts = list(phrases.cut_text(text, most))
        assert b"".join(parts) == text
        assert all(p[-1:] in (b".", b"\n", b"!") for p in parts[:-1])
        assert all(len(p) <= most or not any(c in b".\n!" for c in p[:-1]) for p in parts)


def test_products_beyond_64_bits(spark):
    """Scores of frequencies up to 10**15 are exact."""
    df = spark.createDataFrame([(10**15 - 7, 10**15 - 3, 10**15 - 1)], "a long, l long, r long")
    got = df.select(phrases.score_of("a", "l", "r")).first()[0]
    assert got == 10**6 * (10**15 - 7) ** 2 // ((10**15 - 3) * (10**15 - 1))
