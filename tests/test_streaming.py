"""The stream gives the batch's answer, over several micro-batches and a restart."""

import pytest
from pyspark.sql import functions as F

from seriesloom.sources.tables import series
from seriesloom.streaming.runner import HOUR, Settings, State, drain, feed, in_batch, in_stream

DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    msgs = series(spark, DIR, "click", "view")
    want = in_batch(msgs, Settings()).orderBy("run", "node").collect()
    edges = [0, 300, 600, 10**9]
    for k in range(3):
        part = msgs.where((F.col("seq") >= edges[k]) & (F.col("seq") < edges[k + 1])).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = in_stream(stream, Settings()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("run", "node").collect()
    assert len(got) == len(want) > 100
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a.speed == pytest.approx(b.speed) and a.path == pytest.approx(b.path)


def test_a_batch_of_a_stream_gives_its_budget_at_most(spark, tmp_path):
    """One message far ahead asks for forty rows; batches of later messages, even useless ones, bring them ten at a time."""
    first = [(1, "click", 0, 0, 10.0), (1, "view", 1, 240 * HOUR, 20.0)]
    parts = [first, *[[(1, "view", 2 + k, 240 * HOUR, None)] for k in range(4)]]
    sizes = []
    for part in parts:
        spark.createDataFrame(part, "run long, topic string, seq long, us long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run long, topic string, seq long, us long, value double").parquet(f"{tmp_path}/in")
        q = in_stream(stream, Settings(most_nodes=10)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
        sizes.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert sizes == [10, 20, 30, 40, 41]


def rows(msgs):
    s, c = State(), Settings()
    return [r for m in msgs for r in feed(s, c, *m)], s


def test_bad_values_advance_time_only():
    good = [("click", k * HOUR, 10.0) for k in range(0, 100, 3)]
    bad = [("view", k * HOUR, v) for k, v in zip(range(1, 100, 3), [float("nan"), None, 1e9] * 11)]
    a, _ = rows(good)
    b, _ = rows(sorted(good + bad, key=lambda m: m[1]))
    assert [r["speed"] for r in b[: len(a)]] == [r["speed"] for r in a]


def test_values_count_from_the_next_node():
    out, _ = rows([("click", 0, 10.0), ("click", 6 * HOUR, 90.0), ("click", 12 * HOUR, 90.0)])
    assert [r["stale"] for r in out] == [True, False, False]
    assert out[1]["speed"] < 11 < out[2]["speed"]


def test_lone_outlier_is_held_and_a_confirmed_base_resets():
    base = [("click", k * HOUR, 10.0) for k in range(50)]
    calm, _ = rows(base)
    odd, _ = rows(base[:20] + [("view", 10**15, 5.0)] + base[20:])
    assert odd == calm
    late = [(t, 10**15 + k * HOUR, 7.0) for k, t in enumerate(["click", "view", "click", "view", "click"])]
    _, s = rows(base + late)
    fresh, f = rows(late)
    assert s.session == 1 and s.clock == f.clock and s.path == pytest.approx(f.path)


def test_a_small_bound_delays_rows_and_changes_none():
    msgs = [("click", k * 20 * HOUR, float(10 + k % 7)) for k in range(40)] + [("view", 800 * HOUR + k * HOUR, 30.0) for k in range(30)]
    want, _ = rows(msgs)
    for most in (1, 4):
        s, c = State(), Settings(most_nodes=most)
        got = []
        for m in msgs:
            new = list(feed(s, c, *m))
            assert len(new) <= most
            got += new
        assert s.queue or most > 1
        while rest := list(drain(s, c)):
            got += rest
        assert got == want and not s.queue


def test_a_reset_shows_the_path_before_until_a_value_is_seen():
    base = [("click", k * HOUR, 10.0) for k in range(50)]
    bad = [(t, 10**15 + k * HOUR, None) for k, t in enumerate(["click", "view"] * 9)]
    out, s = rows(base + bad + [("click", 10**15 + 20 * HOUR, 7.0), ("click", 10**15 + 40 * HOUR, 7.0)])
    after = [r for r in out if r["session"] == 1]
    before = [r for r in out if r["session"] == 0][-1]["path"]
    assert after[0]["fallback"] and all(r["path"] == before for r in after if r["fallback"])
    assert not after[-1]["fallback"] and after[-1]["path"] == s.path < before + 1000


def test_a_state_that_is_not_finite_starts_anew_and_keeps_its_path():
    _, s = rows([("click", k * HOUR, 10.0) for k in range(50)])
    path, s.speed = s.path, float("nan")
    out = list(feed(s, Settings(), "click", 80 * HOUR, 10.0))
    assert out[0]["speed"] == 0.0 and out[0]["path"] == path and out[-1]["path"] >= path
