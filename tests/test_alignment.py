"""Alignment of standing, moving and paired starts, in batch and as a stream."""

import math

import pytest
from pyspark.sql import functions as F

from seriesloom.plans import estimation
from seriesloom.streaming.alignment import AlignRules, aligned, in_batch, in_stream

DIR = "/root/testdata/sf0.001"
R = AlignRules(window=100, second_only_after=30, tolerance=2, base=(2.0, 20.0), near=5.0)


def still(antenna, n, x, y=0.0, way=0.0):
    return [(t, antenna, x, y, way) for t in range(n)]


def test_a_standing_start_takes_the_mean_of_what_is_near():
    row = aligned(1, still("master", 5, 10.0) + [(7, "master", 90.0, 0.0, 0.0), (8, "master", 12.0, 0.0, 0.1)], R)
    assert row[3] == pytest.approx(62 / 6)
    assert not row[8] and row[9] == "master" and row[2] == 7
    alone = aligned(1, still("master", 3, 10.0), R)
    assert alone[3:5] == (10.0, 0.0) and alone[6] is None and not alone[7]


def test_a_moving_start_takes_the_last_place_and_its_way():
    row = aligned(1, [(t, "master", float(t), 2.0 * t, float(t)) for t in range(10)], R)
    assert row[3:6] == (9.0, 18.0, 9.0) and row[6] == pytest.approx(math.atan2(9, 18)) and row[7] and row[8]


def test_pairs_give_the_heading():
    row = aligned(1, still("master", 4, 0.0) + [(t, "rover", 3.0, 4.0, 0.0) for t in range(4)] + [(3, "rover", 500.0, 0.0, 0.0)], R)
    assert row[6] == pytest.approx(math.atan2(3, 4)) and row[7]


def test_the_second_antenna_alone():
    assert aligned(1, [(t, "rover", 1.0, 1.0, 0.0) for t in (0, 20)], R) is None
    assert aligned(1, [(t, "rover", 1.0 + t, 1.0, 1.0 * t) for t in (0, 40)], R)[9] == "rover"


def test_rows_that_are_not_valid(spark):
    rows = [(1, 5, "master", 1.0, 1.0, 0.0), (1, 1, "master", None, 1.0, 0.0), (1, 2, "master", float("nan"), 1.0, 0.0), (None, 1, "master", 1.0, 1.0, 0.0), (1, None, "master", 1.0, 1.0, 0.0), (1, 200, "master", 9.0, 9.0, 9.0)]
    got = in_batch(spark.createDataFrame(rows, "run long, us long, antenna string, x double, y double, way double"), R).collect()
    assert [(r.run, r.start, r.used, r.x) for r in got] == [(1, 5, 1, 1.0)]


def test_the_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    fixes = estimation.fixes_of_antennas(spark, DIR).cache()
    want = {r.run: r for r in in_batch(fixes, estimation.ALIGN).collect()}
    low, high = fixes.agg(F.min("us"), F.max("us")).first()
    edges = [low + (high - low) * k // 4 for k in range(5)]
    for k in range(4):
        part = fixes.where((F.col("us") >= edges[k]) & ((F.col("us") < edges[k + 1]) | F.lit(k == 3))).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(fixes.schema).parquet(f"{tmp_path}/in")
        q = in_stream(stream, estimation.ALIGN).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len({r.run for r in got}) == len(got) >= 0.5 * len(want) > 2
    for r in got:
        w = want[r.run]
        assert (r.start, r.used, r.ready, r.moving, r.antenna) == (w.start, w.used, w.ready, w.moving, w.antenna)
        assert (r.x, r.y, r.heading) == pytest.approx((w.x, w.y, w.heading))
    closed = [run for run, w in want.items() if w.start + estimation.ALIGN.window < edges[3]]
    assert set(closed) <= {r.run for r in got}
