"""Order statistics by rounds against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.quantiles import order_statistics, side_by_side


def plain(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low, high = int(at), -int(-at // 1)
    return v[low] if low == high else (high - at) * v[low] + (at - low) * v[high]


@pytest.mark.parametrize(("held", "ranges"), [(10_000, 1024), (3, 16)])
def test_rounds(spark, held, ranges):
    rng = random.Random(held)
    groups = {
        "hot": [rng.gauss(0, 1e3) for _ in range(200)], "ties": [rng.choice([1.0, 1.0, 2.0, -5.0]) for _ in range(90)], "tail": [10.0 ** rng.randint(-200, 200) for _ in range(60)],
        "one": [7.0], "two": [1.0, 2.0], None: [3.0, 9.0, 4.0], "edge": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0],
    }
    rows = [(g, x) for g, v in groups.items() for x in v] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.5, 0.95]
    got = {(r.g, r.q): r.x for r in order_statistics(df, ["g"], "v", qs, held, ranges).collect()}
    assert got == {(g, q): plain(v, q) for g, v in groups.items() for q in qs}
    if held == 10_000:
        same = df.where("not isnan(v)").groupBy("g").agg(F.percentile("v", F.lit(0.95)).alias("p")).where("p is not null").collect()
        assert all(got[r.g, 0.95] == r.p for r in same)


def test_no_groups(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert [(r.q, r.x) for r in order_statistics(df, [], "v", [0.5], 2, 2).collect()] == [(0.5, 5.0)]
    assert order_statistics(df.limit(0), [], "v", [0.5]).count() == 0
    wide = side_by_side(order_statistics(df.withColumn("k", F.lit(1)), ["k"], "v", [0.1, 0.9]), ["k"], {0.1: "low", 0.9: "high"}).first()
    assert (wide.k, wide.low, wide.high) == (1, 1.0, 9.0)
