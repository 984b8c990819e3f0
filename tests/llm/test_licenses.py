"""The classifier on paragraphs that it has not seen; the scan against a brute-force version."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm.licenses import CONFIRM, OTHERS, PLAIN, TEMPLATES, WORD, _sample, classify, find_licenses, grams, pairs, paragraphs, trained, words_in


def guess(text, m):
    at = {f: i for i, f in enumerate(m.features)}
    z = np.array(m.bias) + sum((np.array(m.weights[at[g]]) for g in grams(words_in(text)) if g in at), np.zeros(len(m.bias)))
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return m.families[p.argmax()], p.max()


def plain(text, m):
    """family, p, confirmed of every licence paragraph of a text, without the telling words."""
    lines = re.sub(r"(?<=[^\n]{50})(?<![.:;!?\s])[ \t]*\r?\n(?=[ \t]*[^\s])", " ", text or "").split("\n")
    for line in lines:
        family, p = guess(line, m)
        if family == "none":
            continue
        have = {*words_in(line), *pairs(words_in(line))}
        similar = max(len(have & t) / len(t) for t in ({*pairs(words_in(x))} or {*words_in(x)} for x in TEMPLATES[family]))
        confirmed = similar >= CONFIRM
        yield family if confirmed and (p >= m.least or similar == 1) else "unknown", p, confirmed


def test_new_paragraphs_and_scores(spark):
    m, rng = trained(), random.Random(77)
    rows = [(" ".join(_sample(rng, rng.choice(t))), f) for f, t in TEMPLATES.items() for _ in range(15)]
    rows += [(" ".join(_sample(rng, p)), "none") for p in PLAIN for _ in range(3)] + [(" ".join(_sample(rng, p)), "unknown") for p in OTHERS for _ in range(3)]
    got = {r.line: r for r in classify(spark.createDataFrame(rows, "line string, family string"), m).collect()}
    said = {line: got[line].family if line in got else "none" for line, _ in rows}
    named = [(said[line], f) for line, f in rows if said[line] in TEMPLATES]
    assert np.mean([a == b for a, b in named]) > 0.97
    assert np.mean([said[line] == f for line, f in rows if f in TEMPLATES]) > 0.7
    assert not any(said[line] in TEMPLATES for line, f in rows if f not in TEMPLATES)
    for line, r in got.items():
        want = list(plain(line, m))
        assert len(want) == 1 and abs(want[0][1] - r.p) < 1e-3


def test_telling_words_lose_nothing():
    m = trained()
    w, b = np.array(m.weights), np.array(m.bias)
    free = [i for i, f in enumerate(m.features) if not set(f.split()) & set(m.telling)]
    assert (np.maximum(w[free, :-1] - w[free, -1:], 0).sum(0) + b[:-1] < b[-1]).all()


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_documents(spark):
    m, rng = trained(), random.Random(9)
    texts = ["prose\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", None, "the license plate was lost", "", "Unlicense", "GPLv3", "Eclipse Public License", WRAPPED, "x " * 40_000 + "\nAll rights reserved."]
    parts = [*(x for t in TEMPLATES.values() for x in t), *PLAIN, *OTHERS, "lorem ipsum dolor sit amet", "", "the of and in"]
    texts += ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    docs = spark.createDataFrame([(None if i == 7 else i, t, "x", "y", 0.5) for i, t in enumerate(texts)] + [(0, texts[0], "x", "y", 0.5)], "doc_id long, text string, family string, line string, p double")
    want = defaultdict(list)
    for i, t in [*enumerate(texts), (0, texts[0])]:
        for family, _, confirmed in plain(t, m):
            want[None if i == 7 else i, family].append(confirmed)
    got = {(r.doc_id, r.family): (r.n_paragraphs, r.n_confirmed) for r in find_licenses(docs).collect()}
    assert got == {k: (len(v), sum(v)) for k, v in want.items()}
    assert got[0, "mit"] == (2, 2) and got[8, "mit"] == (1, 1) and got[1, "apache"] == (1, 1) and got[6, "gpl"] == (1, 1) and got[9, "proprietary"] == (1, 1)
    assert find_licenses(docs.limit(0)).count() == 0
    assert WORD and not [k for k in got if k[0] in (2, 3, 4)]


def test_wrapped_lines_join_alike_however_they_end(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "a" * 48, "é" * 50, "\n", "\r\n", "\t", "  ", ".", ". ", ";", "x"]) for _ in range(40)) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", paragraphs(F.col("t")).alias("p")).collect()
    joined = 0
    for r in got:
        want = re.sub(r"(?<=[^\n]{50})(?<![.:;!?\s])[ \t]*\r?\n(?=[ \t]*[^\s])", " ", texts[r.i]).split("\n")
        joined += len(want) < texts[r.i].count("\n") + 1
        assert r.p == want
    assert joined > 50
