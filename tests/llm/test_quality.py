"""Figures against a plain count of the same rules."""

import random
import re
from collections import Counter

from seriesloom.llm.quality import QualityRules, keep_good, quality_figures


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def make(rng):
    words = [rng.choice(["a", "bé", "ccc", "d#", "漢字", "e f", "g"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 150))]
    return "".join(w + rng.choice([" ", "\n", "\t", "  ", "\n\n", "\r\n"]) for w in words)


def test_figures_match_a_plain_count(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "one", "a b c a b c", "x\nx\n\n\nx"] + [make(rng) for _ in range(150)] + ["long " * 20000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    rows = quality_figures(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_verdict_on_repetition(spark):
    rng = random.Random(3)
    clean = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(40))
    junk = "\n".join([passage] * 3 + [f"z{i} y{i}" for i in range(10)])
    docs = spark.createDataFrame([(1, clean, "x"), (2, junk, None), (None, clean, "y")], "doc_id long, text string, extra string")
    assert {(r.doc_id, r.extra) for r in keep_good(docs, QualityRules()).collect()} == {(1, "x"), (None, "y")}
    assert keep_good(docs.limit(0)).count() == 0
