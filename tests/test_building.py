"""Filters against the linear case, the plant, map building, sheets and tables."""

from dataclasses import dataclass

import numpy as np
import pytest

from seriesloom.functions import config
from seriesloom.operators import mapping, rules
from seriesloom.streaming.filters import SigmaFilter


def test_sigma_filter_equals_kalman_when_linear():
    a, q, r = np.array([[1.0, 0.5], [0.0, 0.9]]), np.diag([0.1, 0.2]), 0.7
    flt = SigmaFilter(lambda x, u: a @ x + np.array([0, u]), np.zeros(2), np.eye(2) * 4, q, gate=1e9)
    x, p = np.zeros(2), np.eye(2) * 4
    rng = np.random.default_rng(1)
    for _ in range(40):
        u, z = rng.normal(), rng.normal()
        flt.predict(u)
        flt.update(z, lambda s: s[0], r)
        x, p = a @ x + np.array([0, u]), a @ p @ a.T + q
        k = p[:, 0] / (p[0, 0] + r)
        x, p = x + k * (z - x[0]), p - np.outer(k, p[0])
    assert flt.x == pytest.approx(x) and flt.p == pytest.approx(p)


def test_gate_refuses_outliers_and_bad_values():
    flt = SigmaFilter(lambda x, u: x, np.zeros(1), np.eye(1), np.eye(1) * 0.01)
    assert not flt.update(100.0, lambda s: s[0], 1.0) and not flt.update(float("nan"), lambda s: s[0], 1.0)
    assert flt.update(1.0, lambda s: s[0], 1.0)


def test_starts_with_refractory(spark):
    v = [0, 0, 5, 9, 0, 0, 6, 9, 0, 0, 0, 0, 0, 5, 9]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "run long, seq long, value double")
    assert sorted(r.seq for r in mapping.starts(df, "run", "seq", "value", 5, 8, 5, 2).collect()) == [2, 13]


def test_hybrid_keeps_all_weight(spark):
    cloud = spark.createDataFrame([(1, 0.1, 0.0, 2.0), (2, 0.2, 0.1, 3.0), (3, 9.0, 9.0, 4.0)], "key int, x double, y double, weight double")
    graph = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id int, x double, y double")
    assert sorted(tuple(r) for r in mapping.hybrid(cloud, graph, 1.0).collect()) == [(0.0, 0.0, 5.0), (5.0, 5.0, 0.0), (9.0, 9.0, 4.0)]


def test_rules(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(rules.number(F.lit(t))) for t in ("1.5", "x", "NaN", "Infinity", None)] == [1.5, None, None, None, None]
    assert one(rules.table_1d(F.lit(7.0), [0.0, 10.0], [0.0, 1.0])) == pytest.approx(0.7)
    assert one(rules.table_2d(F.lit(0.5), F.lit(0.5), 2, 2, 1, 1, [0.0, 1.0, 2.0, 3.0])) == pytest.approx(1.5)
    assert [one(rules.median_of(F.array(*map(F.lit, v)))) for v in ([3.0, 1.0, 2.0], [4.0, 1.0])] == [2.0, 2.5]
    with pytest.raises(Exception, match="unknown name"):
        one(rules.code_of(F.lit("what"), {"a": ["b"]}))


@dataclass(frozen=True)
class Sheet:
    step: int = 5
    gain: float = 0.5
    on: bool = False


def test_sheets(tmp_path):
    assert config.overridden(Sheet(), "step=7, on=true") == Sheet(7, 0.5, True)
    for bad in ("nope=1", "step"):
        with pytest.raises(KeyError):
            config.overridden(Sheet(), bad)
    (tmp_path / "s.json").write_text('{"gain": 2.0}')
    assert config.loaded(Sheet(), f"{tmp_path}/s.json") == Sheet(gain=2.0)
    assert config.digest(Sheet()) == config.digest(Sheet()) != config.digest(Sheet(6))


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1234, 0.5), ("bb", None, 2.0)], "name string, n int, x double")
    assert config.markdown(df).split("\n") == ["| name |     n |     x |", "|------|------:|------:|", "| a    | 1,234 | 0.500 |", "| bb   |       | 2.000 |"]
