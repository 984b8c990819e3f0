"""Folds: states, late rows, branches, corrections; each against a plain loop over rows in order."""

import random
import sys
from dataclasses import dataclass, field

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from seriesloom.operators import corrections, folds
from seriesloom.operators.corrections import Rules, Track, judge
from seriesloom.plans import estimation
from seriesloom.sources.tables import series
from seriesloom.streaming import runner

DIR = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module


@dataclass
class Sum:
    total: int = 0
    seen: list = field(default_factory=list)


def add(s, row):
    s.total = s.total * 3 % 1009 + row["v"]
    s.seen = [*s.seen, row["v"]][-3:]
    return [(row["at"], s.total, sum(s.seen))] if row["v"] != 5 else []


F_ = folds.Fold(Sum, add, ["at", "v"], "at long, total long, recent long")


def rows_of(seed, n, keys=4):
    rng = random.Random(seed)
    return [(rng.choice([*range(keys), None]), at, rng.randint(0, 9)) for at in rng.sample(range(-50, 10 * n), n)]


def plain(rows):
    out = []
    for k in {r[0] for r in rows}:
        s = Sum()
        out += [(k, *x) for _, at, v in sorted(r for r in rows if r[0] == k) for x in add(s, {"at": at, "v": v})]
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, at long, v long").repartition(3)


def test_output_and_states(spark):
    rows = rows_of(1, 300)
    got = folds.fold(frame(spark, rows), ["k"], ["at"], F_, folds.bucket_of("at", 100))
    assert sorted(str(tuple(r)) for r in folds.output(got).select("k", "at", "total", "recent").collect()) == plain(rows)
    kept = folds.states(got, ["k"]).collect()
    assert len({(r.k, r.bucket) for r in kept}) == len(kept) == len({(k, at // 100) for k, at, _ in rows})
    one = next(r for r in kept if r.k == 2 and r.bucket == 10)
    behind = [r for r in rows if r[0] == 2 and r[1] >= 1000]
    start = spark.createDataFrame([(2, one.state)], "k long, state string")
    again = folds.output(folds.fold(frame(spark, behind), ["k"], ["at"], F_, None, start)).select("k", "at", "total", "recent")
    assert {str(tuple(r)) for r in again.collect()} <= set(plain(rows))
    assert folds.fold(frame(spark, []), ["k"], ["at"], F_).count() == 0


def test_late_rows_give_what_rows_in_time_give(spark, tmp_path):
    rows = [r for r in rows_of(2, 400) if r[0] is not None]
    rng = random.Random(3)
    parts = [[], [], []]
    for r in rows:
        parts[rng.choice([0, 0, 0, 1, 2])].append(r)
    parts[2].append((77, 5, 1))  # a key of its own
    line = folds.Timeline(spark, str(tmp_path), ["k"], ["at"], "at", 250, F_)
    for v, part in enumerate(parts, 1):
        line.commit(frame(spark, part), v)
        assert sorted(str(tuple(r)) for r in line.output().select("k", "at", "total", "recent").collect()) == plain(sum(parts[:v], []))
    line.commit(frame(spark, parts[2]), 3)  # repeated
    assert line.output().count() == len(plain(sum(parts, [])))


def test_a_late_row_does_not_read_what_lies_before(spark, tmp_path):
    rows = [(1, at, at % 7) for at in range(0, 1000, 10)]
    line = folds.Timeline(spark, str(tmp_path), ["k"], ["at"], "at", 100, F_)
    line.commit(frame(spark, rows), 1)
    line.commit(frame(spark, [(1, 905, 3)]), 2)
    assert spark.read.parquet(f"{tmp_path}/begins/version=2").first().bucket == 9
    again = spark.read.parquet(f"{tmp_path}/folded/version=2").where("kind = 'row'")
    assert again.agg(F.min("at")).first()[0] == 900 and line.output().count() == len(plain([*rows, (1, 905, 3)]))


def test_branches_equal_full_replays(spark):
    """The registered branches, from snapshots, against the whole run altered; what lies before a snapshot is not needed."""
    got = {}
    for r in estimation.QUERIES["branch_replay"](spark, DIR).collect():
        got.setdefault((r.branch, r.run), []).append(tuple(r[c] for c in ("node", "speed", "variance", "path", "session")))
    msgs = sorted(map(tuple, series(spark, DIR, "click", "view").select("seq", "run", "topic", "us", "value").collect()))
    last = max(m[0] for m in msgs)
    assert len({b for b, _ in got}) == 3
    for branch, share in estimation.BRANCHES.items():
        at, full = int(share * last), {}
        for seq, run, topic, us, value in msgs:
            s = full.setdefault(run, (runner.State(), []))
            settings = runner.Settings(noise=900.0) if branch == "noisy" and seq >= at else runner.Settings()
            if seq >= at and branch == "scaled":
                value = value and value * 1.5
            if seq >= at and branch == "no_clicks" and topic == "click":
                continue
            s[1].extend(runner.feed(s[0], settings, topic, us, value))
        for run, (_, rows) in full.items():
            own = got.get((branch, run), [])
            want = [tuple(x[c] for c in ("node", "speed", "variance", "path", "session")) for x in rows]
            assert own == want[len(want) - len(own) :]
    assert sum(map(len, got.values())) > 500


def test_a_branch_reads_nothing_before_its_snapshot(spark):
    rows = [(1, at, at % 7) for at in range(200)]
    kept = folds.states(folds.fold(frame(spark, rows), ["k"], ["at"], F_, folds.bucket_of("at", 50)), ["k"])
    plan = spark.createDataFrame([(1, "a", 120), (1, "b", 20)], "k long, branch string, at long")
    f = folds.Fold(Sum, lambda s, r: [(r["at"], s.total) for _ in add(s, r)], ["at", "v"], "when_ long, total long")
    poisoned = [(k, at, 5 if at < 100 else v) for k, at, v in rows]
    want, out = Sum(), []
    for _, at, v in rows:
        v = v + 1 if at >= 120 else v
        out += [(at, want.total) for _ in add(want, {"at": at, "v": v})]
    alter = lambda d: d.withColumn("v", F.col("v") + F.col("changed").cast("long"))
    got = folds.branches(frame(spark, poisoned), kept, ["k"], ["at"], "at", 50, f, plan, alter).where("branch = 'a'")
    assert sorted((r["when_"], r.total) for r in got.collect()) == [x for x in out if x[0] >= 100]


R = Rules(jump=2, least_side=4, interval=(10, 1), confirm=3, confirm_time=5, persist=6, persist_jumped=12, delay=0, jump_time=3, far_along=15, far_most=100)


def judged(fixes, r=R):
    """Verdicts and offsets of fixes (us, misfit against a way that stands still at zero, side, status)."""
    s, out = Track(variance=4.0, way=0.0), []
    step = corrections.correction(r).step
    for us, along, side, status in fixes:
        out += [(x[1], round(x[3], 3)) for x in step(s, {"us": us, "along": along, "side": side, "sd": 1.0, "status": status, "way": 0.0})]
    return out, s


def test_small_corrections_and_their_interval():
    out, s = judged([(0, 1.0, 0.0, 2), (0.5, 1.0, 0.0, 2), (2, 1.0, 0.0, 2), (4, 1.0, 0.0, 1), (14, 1.0, 0.0, 1)])
    assert [v for v, _ in out] == ["small", "skipped", "small", "skipped", "small"]
    assert out[0][1] == 0.8 and 0.8 < out[2][1] < out[4][1] < 1.0


def test_a_larger_one_needs_three_that_agree():
    out, _ = judged([(0, 5.0, 0.0, 2), (1, 5.2, 0.0, 2), (2, 4.9, 0.0, 2)])
    assert [v for v, _ in out] == ["waits", "waits", "large"] and out[2][1] == pytest.approx(4.9 * 0.8)
    assert [v for v, _ in judged([(0, 5.0, 0.0, 2), (1, -5.2, 0.0, 2), (2, 4.9, 0.0, 2)])[0]] == ["waits"] * 3
    assert [v for v, _ in judged([(k, 5.0, 0.0, 1) for k in range(9)])[0]] == ["imprecise"] * 9
    assert judged([(0, 5.0, 0.0, 2), (1, 0.1, 0.0, 2), (2, 5.0, 0.0, 2), (3, 5.0, 0.0, 2)])[0][-1][0] == "waits"  # one that agrees begins it anew


def test_an_impossible_one_must_persist_and_moves():
    out, s = judged([(k, 40.0, 0.0, 2) for k in range(10)])
    assert [v for v, _ in out][:7] == ["waits"] * 6 + ["moved"] and out[6][1] == 40.0 and s.variance < 1.01
    out, _ = judged([(k, 9.0, 0.0, 2) for k in range(10)])  # beyond the gate, near: the prior is widened
    assert [v for v, _ in out][:7] == ["waits"] * 6 + ["large"] and out[6][1] == pytest.approx(9 * 81 / 82, abs=1e-3)
    out, _ = judged([(k, 0.0, 30.0, 2) for k in range(10)])  # another branch
    assert out[6] == ("moved", 0.0)
    assert "refused" in [v for v, _ in judged([(k, 2000.0, 0.0, 2) for k in range(10)])[0]]


def test_fixes_that_jump_must_persist_longer():
    calm = [(k, 0.0, 0.0, 2) for k in range(5)]
    out, _ = judged(calm + [(5 + k, 40.0, 0.0, 2) for k in range(14)])
    assert [v for v, _ in out][5:18] == ["waits"] * 12 + ["moved"]
    out, _ = judged(calm + [(5 + k, 40.0, 0.0, 2) for k in range(9)] + [(15, 0.0, 0.0, 2)])
    assert out[-1][1] == pytest.approx(0.0)


def test_late_fixes_of_whole_runs(spark):
    """The registered query against one pass over all fixes in order, and against the same without lateness."""
    _, e = estimation.located(spark, DIR)
    by = {}
    for r in e.collect():
        by.setdefault(r.run, []).append(r.asDict())
    want = []
    for run, own in by.items():
        s = Track()
        for x in sorted(own, key=lambda x: (x["us"], x["seq"])):
            if x["way"] is None:
                continue
            verdict, share, misfit, variance = judge(s, x, estimation.RULES)
            if share:
                s.offset, s.variance, s.way, s.stamp = s.offset + share * misfit, variance, x["way"], x["us"]
            want.append((run, x["us"], verdict, round(s.offset, 6)))
    got = [(r.run, r.us, r.verdict, round(r.offset, 6)) for r in estimation.QUERIES["late_correction"](spark, DIR).collect()]
    assert sorted(got) == sorted(want) and len({v for _, _, v, _ in want}) >= 5


def test_corrected_way(spark):
    at = spark.createDataFrame([(1, t, float(t)) for t in range(0, 100, 10)], "run long, us long, way double")
    v = spark.createDataFrame([(1, 20, 5.0, 1.0), (1, 50, -3.0, 0.5)], "run long, us long, offset double, sigma double")
    got = {r.us: (r.place, r.sigma) for r in corrections.corrected(at, v, 10).collect()}
    assert got[20] == (20.0, None) and got[30] == (35.0, 1.0) and got[50] == (55.0, 1.0) and got[60] == (57.0, 0.5)


def test_epochs_pair_receivers(spark):
    kinds = "run long, seq long, us long, along double, side double, sd double, status int"
    a = spark.createDataFrame([(1, 1, 100, 10.0, 0.0, 1.0, 2), (1, 2, 200, 20.0, 0.0, 1.0, 2), (1, 3, None, 1.0, 0.0, 1.0, 2)], kinds)
    b = spark.createDataFrame([(1, 11, 103, 12.0, 2.0, 2.0, 1), (1, 12, 250, 30.0, 0.0, 1.0, 2)], kinds)
    for bucket in (None, 40):
        got = {r.seq: (r.us, r.along, r.side, round(r.sd, 3), r.status) for r in corrections.epochs(a, b, 5, 1.0, bucket).collect()}
        assert got == {1: (100, 11.0, 1.0, 2.0, 1), 2: (200, 20.0, 0.0, 1.414, 2), 3: (None, 1.0, 0.0, 1.414, 2), 12: (250, 30.0, 0.0, 1.414, 2)}


def test_fixes_are_laid_on_the_way_once(spark):
    """The pairing of fixes reads them from a cut; before, each of its sides held the way and the events again."""
    _, e = estimation.located(spark, DIR)
    assert "parquet" not in e._jdf.queryExecution().optimizedPlan().toString().lower()
