"""Answers of the graph search against brute force."""

import math

import numpy as np

from seriesloom.llm import neighbours
from seriesloom.llm.common import Scratch
from seriesloom.llm.neighbours import build_index, nearest_to_every, search


def brute(rows, every=100, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v) and len(v) == len(rows[0][1])}
    return {q: sorted((math.dist(x, y), i) for i, y in good if i != q)[:k] for q, x in good if q % every == 0}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_recall_copies_and_bad_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).round(4)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(2000 + i, rows[100][1]) for i in range(400)]  # a large group of copies
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [1.0] * 5), (3300, [float("nan")] * 16), (3400, [1.0, None] * 8), (None, [1.0] * 16), (3500, [float("inf")] * 16), rows[7]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string").repartition(3)
    got, want = answers(nearest_to_every(df)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i in got[100]] == list(range(2000, 2010)) and [i for _, i in got[2000]] == [100, *range(2001, 2010)]
    at = dict(rows)
    for q, found in got.items():
        assert found == sorted(found) and all(abs(s - math.dist(at[q], at[i])) < 1e-12 for s, i in found)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {q: [i for _, i in a] for q, a in answers(nearest_to_every(df)).items()} == {0: [100, 3], 100: [0, 3]}
    assert nearest_to_every(df.limit(1)).count() == 0
    assert nearest_to_every(df.limit(0)).count() == 0


def test_shifted_vectors_two_levels_and_queries_from_outside(spark):
    """A shift of all vectors changes nothing, cells below the pivots lose nothing, and a query needs no row of its own."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    x = centres[rng.integers(0, 9, 1200)] + 0.4 * rng.normal(size=(1200, 16)) + 3000.0
    q = centres[rng.integers(0, 9, 40)] + 0.4 * rng.normal(size=(40, 16)) + 3000.0
    scratch = Scratch(spark, "outside")
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    index = build_index(df, scratch, pivots=4, chunk=60)
    assert index.cells is not None and index.cells.count() > 20
    asked = spark.createDataFrame([(i, v.tobytes(), None) for i, v in enumerate(q)], "query_id long, qvec binary, own long")
    got = answers(search(index, asked, scratch, beam=64))
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    hits = sum(len({i for _, i in got[j]} & set(np.argsort(d[j])[:10].tolist())) for j in range(40))
    assert hits >= 0.95 * 400
    assert all(abs(s - d[j, i]) < 1e-9 for j, found in got.items() for s, i in found)


def test_an_edge_stays_new_until_it_was_introduced(spark, monkeypatch):
    """With room for one guest a round only, pairs that the bound puts off still meet."""
    monkeypatch.setattr(neighbours, "MEET", 6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(2)
    got = answers(nearest_to_every(df, every=10, degree=10))
    want = brute(list(enumerate(x.tolist())), every=10)
    assert sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) >= 0.95 * sum(map(len, want.values()))
