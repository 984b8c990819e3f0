"""Fitted tables against a dense least-squares solution; scenarios against runs of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import tables
from seriesloom.plans import estimation
from seriesloom.sources.tables import series
from seriesloom.streaming import runner

DIR = "/root/testdata/sf0.001"
U, V = [-2.0, -0.5, 0.0, 1.0, 3.0], [0.0, 1.0, 4.0]


def weights(x, grid):
    x = min(max(x, grid[0]), grid[-1])
    i = max(k for k in range(len(grid) - 1) if grid[k] <= x)
    t = (x - grid[i]) / (grid[i + 1] - grid[i])
    return {i: 1 - t, i + 1: t}


def design(u, v):
    row = np.zeros(len(U) * len(V))
    for i, a in weights(u, U).items():
        for j, b in weights(v, V).items():
            row[i * len(V) + j] += a * b
    return row


def test_a_fit_equals_a_dense_solution(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-3, 4), rng.uniform(-1, 5), rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None)], "u double, v double, y double").repartition(3)
    got = tables.fitted_table(df, F.col("u"), F.col("v"), F.col("y"), U, V, (0.7, 0.2), per=100.0)
    a, y = np.array([design(u, v) for u, v, _ in rows]), np.array([r[2] for r in rows])
    extra = []
    for i in range(len(U)):
        for j in range(len(V)):
            for di, dj, w in ((0, 1, 0.2), (1, 0, 0.7)):
                if i + di < len(U) and j + dj < len(V) and not (di and U[i] < 0 <= U[i + 1]):
                    r = np.zeros(len(U) * len(V))
                    r[i * len(V) + j], r[(i + di) * len(V) + j + dj] = w, -w
                    extra.append(r * (len(rows) / 100.0) ** 0.5)
    want = np.linalg.lstsq(np.vstack([a, *extra]), np.concatenate([y, np.zeros(len(extra))]), rcond=None)[0]
    assert np.abs(got.ravel() - want).max() < 1e-6
    seen = tables.predicted(df, got, F.col("u"), F.col("v"), U, V, "p").collect()
    assert sum(r.p is None for r in seen) == 2
    assert all(r.p == pytest.approx(design(r.u, r.v) @ want, abs=1e-6) for r in seen if r.p is not None)


def test_signs():
    w = np.array([[1.0, -3.0], [0.0, 0.0], [-1.0, 2.0]])
    assert tables.sign_constrained(w, [-1.0, 0.0, 1.0]).tolist() == [[0.0, -3.0], [0.0, 0.0], [0.0, 2.0]]


def test_the_registered_fit(spark):
    found = {(r.u, r.v): r.value for r in estimation.QUERIES["fitted_table"](spark, DIR).collect()}
    assert len(found) == len(estimation.GRID_U) * len(estimation.GRID_V)
    assert all((u > 0 and x >= found[0.0, v]) or (u < 0 and x <= found[0.0, v]) or u == 0 for (u, v), x in found.items())


def test_scenarios_equal_runs_of_their_own(spark):
    got = {}
    for r in estimation.scenario_rows(spark, DIR).collect():
        got.setdefault((r.scenario, r.arm, r.run), []).append((r.node, r.speed))
    msgs = sorted(map(tuple, series(spark, DIR, "click", "view").select("seq", "run", "topic", "us", "value").collect()))
    at = int(estimation.DEPARTS * max(m[0] for m in msgs))
    keep = {"all": lambda m: True, "no_clicks": lambda m: m[2] != "click", "thinned": lambda m: m[0] % 3 == 0, "first_half": lambda m: m[3] % estimation.SPAN < estimation.SPAN / 2}
    for scenario, stays in keep.items():
        for arm, settings in estimation.ARMS.items():
            full = {}
            for m in msgs:
                if m[0] >= at and not stays(m):
                    continue
                s = full.setdefault(m[1], (runner.State(), []))
                s[1].extend(runner.feed(s[0], settings if m[0] >= at else runner.Settings(), *m[2:]))
            for run, (_, rows) in full.items():
                own, want = got.get((scenario, arm, run), []), [(x["node"], x["speed"]) for x in rows]
                assert own == want[len(want) - len(own) :]
    assert {k[:2] for k in got} == {(s, a) for s in keep for a in estimation.ARMS}
    scored = estimation.QUERIES["scenario_evaluation"](spark, DIR).collect()
    assert len(scored) == 12 and all(r.n > 0 and r.rmse > 0 for r in scored)
