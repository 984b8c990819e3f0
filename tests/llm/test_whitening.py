"""Whitening against a dense decomposition, and its defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import whitening
from seriesloom.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")


def dense(vectors, wanted=32):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    b = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(b.T @ b / n)
    e, v = e[::-1][:wanted], v[:, ::-1][:, :wanted]
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x], b @ v / np.sqrt(e), e / np.trace(b.T @ b / n)


def check(got, ids, vectors, wanted=32):
    n, deviation, white, share = dense(vectors, wanted)
    assert len(got) == n * min(wanted, len(vectors[0]))
    place = {v: [i for i, w in enumerate(ids) if w == v] for v in ids}
    table = np.zeros_like(white)
    for r in got:
        assert r.n == n and r.deviation == deviation[place[r.vec_id][0]] and r.identity_error <= 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        table[place[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-7


def test_the_query_equals_a_dense_decomposition(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    check(QUERIES["op11_embedding_whitening"](spark, DIR).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_a_falling_spectrum_needs_no_full_dimension(spark):
    rng = np.random.default_rng(1)
    scale = 4.0 ** -np.arange(9)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0][:9]
    vectors = (3 + rng.standard_normal((400, 9)) * scale * 1e6 @ turn).astype(np.float32)
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    model = whitening.fit(df, wanted=4)
    assert not model.full
    _, _, _, share = dense(vectors.tolist(), 4)
    assert np.abs(model.variances / model.trace / share - 1).max() < 1e-9
    flat = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((300, 60)))])
    assert whitening.fit(flat, wanted=4).full


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((50, 5)).astype(np.float32))]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 0.0, 0.0, 0.0], 1), (93, [float("nan")] * 5, 1), (94, [float("inf")] * 5, 1), (95, [1.0, 2.0], 1), (96, [1e30] * 5, 1)]
    rows = [*good, (None, good[0][1], 2), (7, good[7][1], 3)]  # without an id, and a repeated row
    got = whitening.whitening_table(frame(spark, [*rows, *bad])).collect()
    assert len(got) == 52 * 5 and {r.n for r in got} == {52}
    assert sum(r.vec_id is None for r in got) == 5 and sum(r.vec_id == 7 for r in got) == 10
    again = whitening.whitening_table(frame(spark, rows).withColumnRenamed("n", "whitened")).collect()
    check([r for r in again if r.vec_id not in (None, 7)] + [r for r in again if r.vec_id in (None, 7)], [r[0] for r in rows], [r[1] for r in rows])


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5])
def test_nothing_to_scale(spark, rows):
    got = whitening.whitening_table(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0


def test_a_direction_without_variance_is_left_out(spark):
    rng = np.random.default_rng(3)
    got = whitening.whitening_table(frame(spark, [(i, [float(a), float(b), 2.0], 0) for i, (a, b) in enumerate(rng.standard_normal((30, 2)))]))
    assert got.agg(F.max("component")).first()[0] == 2 and got.agg(F.max("identity_error")).first()[0] < 1e-9


def test_deviation_beyond_64_bits():
    x = np.array([[1_000_000, 1_000_000 + (1 << 40)], [1_000_000, 1_000_000]], np.int64)
    assert whitening.deviations(x, np.array([1_000_000, 1_000_000]), np.array([0, 1]), 1 << 30) == [None, 1]
    assert whitening.deviations(x[1:], np.array([999_999, 1_000_000]), np.array([0, 1]), 3) == [10]
