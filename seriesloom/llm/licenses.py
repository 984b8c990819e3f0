"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line; a line of fifty characters or more that ends no sentence
goes on in the next one, as in wrapped text.  It is scored by multinomial
logistic regression over its word 1- and 2-grams; the classes are licence
families and `none`.  The model is fitted once, on the driver, to a bounded
sample made from the labelled paragraphs below.  It is calibrated on templates
that were left out of a first fit, and on licences of no family: from which
probability on is a family right in 95 of 100 cases.  A family is reported only
if that holds and one of its templates confirms it; else a paragraph that is
not `none` is reported as `unknown`.

A paragraph is scored only if it has one of the model's telling words.  They
follow from the weights: without any of them no family can outweigh `none`, so
nothing is lost by it.

Scoring uses DataFrame functions only.  Equal paragraphs are scored once.

Defined results: documents without a licence paragraph give no row; a null or
empty text has none; repeated rows add to the counts of their doc_id; a null
doc_id is a value of its own; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled paragraphs, whole ones of licence texts and short notices by which licences are commonly named.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license", "This project is distributed under the terms of the MIT license", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "This software is released under the Apache License version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License", "Released under the GPL version 2", "Released under the GPLv3", "GPLv3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License", "Released under the LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License version 3", "Released under the AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "bsd": [
        "Released under the BSD license", "Licensed under the 3-clause BSD license", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License version 2.0", "Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl": [
        "Licensed under the Eclipse Public License", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "isc": ["Released under the ISC license", "ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["Released under the Unlicense", "The Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Shared under the Creative Commons Attribution-NonCommercial license", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Released under CC0 1.0", "Dedicated to the public domain under CC0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright (c) the company. All rights reserved.", "This software is proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the copyright owner."],
}
#: Licences that belong to no family above, for calibration, and their words in plain use.
OTHERS = ["Released under the zlib license", "Distributed under the Boost Software License, Version 1.0.", "Released under the Artistic License 2.0", "Licensed under the European Union Public Licence", "Released under the PostgreSQL licence", "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License", "This data is made available under the Open Database License"]
PLAIN = [
    "You need a license to drive a car", "The license plate was lost", "The permission of the teacher was needed", "He lost his driving licence in May", "The warranty ends after two years", "A copy of the letter was free of charge", "The version of the story that she told was true",
    "The public library is open", "The Apache helicopter landed", "The MIT campus is near the river", "The GNU is a large animal", "Creative people share their work", "The software was slow", "Copyright law is hard to read", "The redistribution of land took years", "Reserved seats are in the first row", "The BSD team won the cup",
    "All rights and duties of members are listed", "The hotel has reserved a table for late guests", "The general public was invited", "The source of the river is unknown", "The terms of the contract were fair", "The name of the author was not known", "The solar eclipse was seen by the public", "The price is without tax", "This file was moved", "The mozilla of the story is a lizard", "The parties use the commons as they like", "The foundation was published by the state",
]
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: The bound on the sample: so many paragraphs of each class are made.
PER_CLASS = 150
#: A template confirms a paragraph that has so much of its 2-grams.
CONFIRM = 0.6
#: Words that are no features on their own.
COMMON = frozenset("a an and any are as at be been but by can for from had has have he her his if in is it its may must no nor not of on one or other our shall she should so such than that the their there these they this those to was we were what when where which who will with would you your".split())


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def grams(words: list[str]) -> list[str]:
    """Words and pairs of words, but for those that are common altogether."""
    own = [w for w in words if w not in COMMON]
    return list(dict.fromkeys([*own, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in COMMON or b not in COMMON)]))


class LicenseModel(NamedTuple):
    families: list[str]
    features: list[str]
    weights: list[list[float]]
    bias: list[float]
    least: float
    telling: list[str]


def _sample(rng: random.Random, text: str) -> list[str]:
    """A paragraph with some words dropped and ordinary words around it."""
    words = [w for w in words_in(text) if rng.random() > 0.06] or words_in(text)
    filler = lambda n: ["".join(rng.choice("aeioutrsnlhd") for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(0, n))]
    return filler(rng.choice([0, 0, 6])) + words + filler(rng.choice([0, 0, 6]))


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def matrix(samples: list[list[str]], at: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(samples), len(at) + 1), np.float32)
    x[:, -1] = 1
    for i, words in enumerate(samples):
        x[i, [at[g] for g in grams(words) if g in at]] = 1
    return x


def fitted(rows: list[tuple[list[str], int]], classes: int, steps: int) -> tuple[dict[str, int], np.ndarray]:
    """Features that occur eight times, and their weights; the last row is the bias."""
    seen = Counter(g for words, _ in rows for g in grams(words))
    at = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 8))}
    x, y = matrix([r[0] for r in rows], at), np.eye(classes, dtype=np.float32)[[r[1] for r in rows]]
    w = moved = np.zeros((x.shape[1], classes), np.float32)
    for _ in range(steps):
        moved = 0.9 * moved + x.T @ (probabilities(x, w) - y) / len(y) + 2e-4 * w
        w = w - 0.8 * moved
    return at, np.round(w.astype(float), 6)


def telling_words(features: list[str], w: np.ndarray) -> list[str]:
    """Words without which no family outweighs `none` (the last class).

    The features are taken by falling gain until those that are left could not
    make up for the bias, even all together; then the words of those taken.
    """
    gain = np.maximum(w[:-1, :-1] - w[:-1, -1:], 0)
    gap = w[-1, -1] - w[-1, :-1]
    if (gap <= 0).any():
        raise ValueError("a paragraph without features must be none")
    order = np.argsort(gain.max(1), kind="stable")
    left = np.cumsum(gain[order], 0)
    spare = int((left < gap - 1e-3).all(1).sum())  # the smallest gains that together stay below the gap
    taken = [features[i] for i in order[spare:]]
    # of a pair, one word tells; those that many features share come first
    words = {f for f in taken if " " not in f}
    for f in sorted(f for f in taken if " " in f):
        a, b = f.split()
        if a not in words and b not in words:
            words.add(min((x for x in (a, b)), key=lambda x: (x in COMMON, x)))
    return sorted(words)


@lru_cache(1)
def trained(seed: int = 5, steps: int = 300) -> LicenseModel:
    rng = random.Random(seed)
    families = [*TEMPLATES, "none"]
    none = len(families) - 1

    def sampled(templates: list[list[str]], plain: list[str]):
        rows = [(_sample(rng, t[i % len(t)]), k) for k, t in enumerate(templates) for i in range(PER_CLASS)]
        return rows + [(_sample(rng, rng.choice(plain)) if i % 6 else _sample(rng, ""), none) for i in range(4 * PER_CLASS)]

    # calibration: every fourth template is left out of a first fit
    known = [[x for i, x in enumerate(t) if i % 4 != 3] for t in TEMPLATES.values()]
    held = [[x for i, x in enumerate(t) if i % 4 == 3] for t in TEMPLATES.values()]
    at, w = fitted(sampled(known, PLAIN[::2]), none + 1, steps)
    rows = [(_sample(rng, x), k) for k, t in enumerate(held) for x in t for _ in range(20)]
    rows += [(_sample(rng, x), none) for x in PLAIN[1::2] for _ in range(20)] + [(_sample(rng, x), -1) for x in OTHERS for _ in range(20)]
    p = probabilities(matrix([r[0] for r in rows], at), w)
    true, best, said = np.array([r[1] for r in rows]), p.max(1), p.argmax(1)
    use = said != none
    least = next((t for t in sorted(best[use]) if (true[use & (best >= t)] == said[use & (best >= t)]).mean() >= 0.95), 1.0)
    at, w = fitted(sampled(list(TEMPLATES.values()), PLAIN), none + 1, steps)
    features = list(at)
    return LicenseModel(families, features, w[:-1].tolist(), w[-1].tolist(), round(float(least), 6), telling_words(features, w))


def has_telling(text: Column, model: LicenseModel) -> Column:
    return F.arrays_overlap(words_of(text), F.array(*map(F.lit, model.telling)))


def paragraphs(text: Column) -> Column:
    """Lines; a long line that ends no sentence goes on in the next one."""
    # the line's end is looked for first: fifty characters back from every character would cost fifty times the text
    return F.split(F.regexp_replace(text, r"(?<![.:;!?\s])(?=[ \t]*\r?\n[ \t]*\S)(?<=[^\n]{50})[ \t]*\r?\n", " "), "\n", -1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def classify(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """line, family, p, similarity, confirmed of every distinct paragraph `line` that is a licence paragraph."""
    spark, k = lines.sparkSession, len(model.families)
    # bounded: some thousand features of k weights
    weights = spark.createDataFrame([(f, w) for f, w in zip(model.features, model.weights, strict=True)], "gram string, weight array<double>")
    cut = lines.select("line").distinct().withColumn("words", words_of(F.col("line")))
    parts = cut.select("line", F.explode(F.array_distinct(F.concat("words", pairs_of(F.col("words"))))).alias("gram")).join(F.broadcast(weights), "gram")
    sums = parts.groupBy("line").agg(*(F.sum(F.get("weight", F.lit(i))).alias(f"z{i}") for i in range(k)))
    z = [F.round(F.col(f"z{i}") + F.lit(b), 6) for i, b in enumerate(model.bias)]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    names = F.array(*map(F.lit, model.families))
    scored = sums.select("line", F.get(names, F.array_position(F.array(*z), top).cast("int") - 1).alias("guess"), (F.lit(1.0) / total).alias("p")).where("guess <> 'none'")
    parts_of = {f: [sorted(set(pairs(words_in(t)) or words_in(t))) for t in ts] for f, ts in TEMPLATES.items()}
    words = words_of(F.col("line"))
    scored = scored.withColumn("have", F.array_distinct(F.concat(words, pairs_of(words))))
    share = lambda t: F.size(F.array_intersect("have", F.array(*map(F.lit, t)))) / F.lit(float(len(t)))
    similar = F.coalesce(*(F.when(F.col("guess") == f, F.greatest(*(share(t) for t in ts), F.lit(0.0))) for f, ts in parts_of.items()))
    scored = scored.withColumn("similarity", F.round(similar, 6)).withColumn("confirmed", F.col("similarity") >= CONFIRM)
    sure = F.col("confirmed") & ((F.col("p") >= model.least) | (F.col("similarity") == 1))
    return scored.select("line", F.when(sure, F.col("guess")).otherwise(F.lit("unknown")).alias("family"), F.round("p", 6).alias("p"), "similarity", "confirmed")


def find_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, family, n_paragraphs, n_confirmed, p, similarity: a row per document and family found in it."""
    model = model or trained()
    has = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = has.select("doc_id", F.explode(paragraphs(F.col("text"))).alias("line")).where(has_telling(F.col("line"), model))
    found = lines.join(classify(lines, model), "line")
    return found.groupBy("doc_id", "family").agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"), F.max("p").alias("p"), F.max("similarity").alias("similarity")
    )
