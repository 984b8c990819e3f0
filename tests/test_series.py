"""Small series with answers worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import faults, fitting, grid, islands, running, sets, spatial, stats, timejoin
from seriesloom.operators.lineage import cut
from seriesloom.plans.catalogue import QUERIES

S = "run long, seq long, us long, value double"


def at(spark, rows):
    return spark.createDataFrame([(1, i, int(t), v) for i, (t, v) in enumerate(rows)], S)


def test_nearest_goes_to_the_later_row_on_a_tie(spark):
    ref = at(spark, [(0, 0.0), (1_020_000, 0.0), (5_049_000, 0.0), (1_025_000, 0.0), (20_000_000, 0.0)])
    out = at(spark, [(k * 50_000, k * 0.05) for k in range(200)])
    got = {r.us: (r.ok, r.other_value) for r in timejoin.nearest(ref.drop("value"), out, "run", "us", ["value"], 50_000, "seq").collect()}
    assert [got[t][0] for t in (0, 1_020_000, 5_049_000, 20_000_000)] == [True, True, True, False]
    assert got[1_020_000][1] == pytest.approx(1.0) and got[1_025_000][1] == pytest.approx(1.05)


def test_asof_modes_ties_and_buckets(spark):
    right = at(spark, [(10, 1.0), (10, 2.0), (30, 3.0)])
    left = at(spark, [(5, 0.0), (10, 0.0), (29, 0.0), (30, 0.0), (95, 0.0)]).drop("value")
    for bucket in (None, 20):
        got = lambda **k: [r.other_value for r in timejoin.asof(left, right, "run", "us", ["value"], tie="seq", bucket=bucket, **k).orderBy("us").collect()]
        assert got() == [None, 2.0, 2.0, 3.0, 3.0]
        assert got(before_first="clamp") == [1.0 if bucket else 1.0, 2.0, 2.0, 3.0, 3.0]
        assert got(before_first="zero") == [0.0, 2.0, 2.0, 3.0, 3.0]
    assert [r.other_value for r in timejoin.asof_forward(left, right, "run", "us", ["value"], "seq").orderBy("us").collect()] == [1.0, 2.0, 3.0, 3.0, None]


def test_interpolation_clamps(spark):
    right, left = at(spark, [(10, 1.0), (20, 3.0)]), at(spark, [(0, 0.0), (10, 0.0), (15, 0.0), (99, 0.0)]).drop("value")
    assert [r.interp_value for r in timejoin.interpolate(left, right, "run", "us", "value").orderBy("us").collect()] == [1.0, 1.0, 2.0, 3.0]


def test_order_of_input_rows_does_not_matter(spark):
    rows = [(k * 7 % 50, float(k)) for k in range(50)]
    a = at(spark, rows)
    b = a.orderBy(F.rand(3)).repartition(3)
    for op in (lambda d: running.rolling_median(d, ["run"], "seq", "value", 2, "m"), lambda d: grid.cumulative(d, ["run"], [F.col("seq")], "value", "p"), lambda d: islands.sessions(d, ["run"], [F.col("us")], 0)):
        assert sorted(map(tuple, op(a).collect())) == sorted(map(tuple, op(b).collect()))


def test_islands_and_recovery(spark):
    d = at(spark, [(0, 9.0), (1, 9.0), (2, 1.0), (3, 9.0), (5, 9.0), (9, 9.0)])
    runs = sorted((r.start, r.end, r.rows) for r in islands.true_runs(d, ["run"], [F.col("us")], F.col("value") > 5).collect())
    assert runs == [(0, 1, 2), (3, 9, 3)]
    assert [r.start for r in islands.recovery(d, ["run"], F.col("value") > 5, 4).collect()] == [3]


def test_weights_skip_nulls_per_measure(spark):
    d = spark.createDataFrame([(1.0, 2.0, 10), (None, 4.0, 30), (3.0, None, 10)], "a double, b double, n int")
    a, b = d.agg(stats.weighted_mean(F.col("a"), F.col("n")), stats.weighted_mean(F.col("b"), F.col("n"))).first()
    assert (a, b) == (2.0, 3.5)


def test_faults_touch_only_their_window(spark):
    d = at(spark, [(k * 100_000, 30.0) for k in range(4000)])
    start, length = F.lit(100_000_000), 20_000_000
    for kind in faults.KINDS:
        got = {r.seq: r for r in faults.with_fault(d, kind, start, length).collect()}
        again = {r.seq: r for r in faults.with_fault(d, kind, start, length).collect()}
        assert got == again
        assert all(got[k].value == 30.0 and got[k].us == k * 100_000 for k in range(4000) if not 990 <= k < 1200)
    count = lambda kind, f: faults.with_fault(d, kind, start, length).where(f).count()
    assert count("zero", "value = 0") == 200 and count("drop", "true") == 3800 and count("missing", "value is null") == 1
    assert count("zero_then_drop", "value = 0") == 10 and count("outliers", "value = 90") == 6


def test_components_and_first_fit(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    labels = {r.node: r.label for r in sets.components(edges).collect()}
    assert {labels[k] for k in range(41)} == {0} and labels[103] == 100
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 6.0, 0.0)], "g long, k long, x double, y double")
    assert {r.k: r.cluster for r in sets.first_fit(pts, "g", "k", "x", "y", 4.0).collect()} == {0: 0, 1: 0, 2: 2}


def test_first_fit_against_a_plain_loop(spark):
    rng = random.Random(5)
    pts = [(g, k, rng.uniform(0, 30), rng.uniform(0, 30)) for g in range(2) for k in rng.sample(range(900), 90)] + [(0, 1000, 3.0, 3.0), (0, 1001, 3.0, 3.0), (None, 1, 0.0, 0.0), (1, 2000, None, 1.0)]
    want = {}
    for g in range(2):
        own = sorted((k, x, y) for q, k, x, y in pts if q == g and x is not None)
        for k, x, y in own:
            if (g, k) not in want:
                want |= {(g, j): k for j, u, v in own if (g, j) not in want and math.hypot(u - x, v - y) <= 4.0}
    df = spark.createDataFrame(pts, "g long, k long, x double, y double").repartition(3)
    assert {(r.g, r.k): r.cluster for r in sets.first_fit(df, "g", "k", "x", "y", 4.0).collect()} == want


def test_components_of_long_chains(spark):
    line = [0, *range(150, 0, -1)]  # the least label moves one node a round
    edges = spark.createDataFrame([*zip(line, line[1:]), (500, 500), (700, 701), (None, 3), (900, None)], "a long, b long")
    labels = {r.node: r.label for r in sets.components(edges).collect()}
    assert labels == {**dict.fromkeys(line, 0), 500: 500, 700: 700, 701: 700}
    # the chains of all customers, that the registered query has two thirds of
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").selectExpr("c_custkey a", "c_custkey + 1 + c_nationkey b").where("b <= 1500")
    want = {}

    def root(x):
        while want.setdefault(x, x) != x:
            want[x] = x = want[want[x]]
        return x

    for r in c.collect():
        x, y = sorted((root(r.a), root(r.b)))
        want[y] = x
    assert len(want) > 1000 and {r.node: r.label for r in sets.components(c).collect()} == {x: root(x) for x in list(want)}


def test_projection_on_a_straight_line(spark):
    seg = spark.createDataFrame([(k, k * 10.0, 0.0, k * 10 + 10.0, 0.0, k * 10.0) for k in range(100)], "seg int, ax double, ay double, ex double, ey double, s0 double")
    r = spatial.project(spark.createDataFrame([(1, 503.0, 1.5)], "k int, px double, py double"), seg, "k", 10).first()
    assert (r.along, r.cross) == (pytest.approx(503.0), pytest.approx(1.5))


def test_projection_on_the_line_of_all_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    segs = sorted(r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect())
    want = {}
    for (c,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect():
        px, py, near = c * 0.4 + c % 7, c % 41 - 16.0, []
        for k in segs:
            ax, ay, dy = k * 6.0, k % 2 * 8.0, 8.0 - k % 2 * 16.0
            t = min(max(((px - ax) * 6 + (py - ay) * dy) / 100, 0), 1)
            d, turn = math.hypot(px - ax - t * 6, py - ay - t * dy), 6 * (py - ay) - dy * (px - ax)  # as in the SQL of polyline_projection
            near.append((round(d, 9), k, k * 10 + t * 10, d * ((turn > 0) - (turn < 0))))
        if min(near)[0] <= 14:
            want[c] = min(near)
    got = {r.k: r for r in QUERIES["polyline_projection_whole"](spark, sf).collect()}
    assert got.keys() == want.keys() and len({r.seg for r in got.values()}) > 0.9 * len(segs)
    for c, (_, seg, along, cross) in want.items():
        assert got[c].seg == seg and got[c].along == pytest.approx(along, abs=2e-6) and got[c].cross == pytest.approx(cross, abs=2e-6)


def test_delta_restores_the_values(spark):
    d = at(spark, [(k, None if k % 4 == 1 else math.sin(k) * 10) for k in range(20)])
    rows = grid.delta_encoded(d, ["run"], [F.col("seq")], "value", 100).orderBy("seq").collect()
    total = 0
    for r in rows:
        if r.quant is not None:
            total += r.delta
            assert total == r.quant == round(r.value * 100)


def test_rows_without_key_or_time_stay_and_meet_nothing(spark):
    kinds = "run long, us long, value double"
    left = spark.createDataFrame([(1, 15, 0.0), (1, None, 0.0), (None, 15, 0.0), (None, None, 0.0), (1, 95, 0.0), (2, 5, 0.0)], kinds)
    right = spark.createDataFrame([(1, 10, 1.0), (1, None, 2.0), (None, 10, 3.0), (1, 20, 4.0), (2, 90, 6.0)], kinds)
    want = [(1, 15, 1.0, 4.0), (1, None, None, None), (None, 15, None, None), (None, None, None, None), (1, 95, 4.0, None), (2, 5, None, 6.0)]
    for bucket in (None, 7, 30):
        got = timejoin.around(left, right, "run", "us", ["value"], bucket=bucket).collect()
        assert sorted(map(str, ((r.run, r.us, r.prev and r.prev.value, r.next and r.next.value) for r in got))) == sorted(map(str, want))
        for op in (
            lambda: timejoin.nearest(left, right, "run", "us", ["value"], 6, bucket=bucket), lambda: timejoin.interpolate(left, right, "run", "us", "value", bucket=bucket),  # noqa: B023
            lambda: timejoin.fresh(left, right, "run", "us", 9, bucket), lambda: timejoin.history(left, right, "run", "us", "value", 2, 9, bucket), lambda: timejoin.first_response(left, right, "run", "us", bucket),  # noqa: B023
        ):
            assert op().count() == 6


def test_only_inputs_count_among_the_last(spark):
    kinds = "run long, arr long, us long"
    inputs = spark.createDataFrame([(1, 0, 100)], kinds)
    outputs = spark.createDataFrame([(1, k, 200 + k) for k in range(1, 301)], kinds)
    assert all(r.age == r.arr for r in timejoin.freshest_of(outputs, inputs, "run", "us", "arr").collect())
    # 70 inputs, of which the last 3 lie ahead of the output; and only the last `last` are looked at
    inputs = spark.createDataFrame([(1, k, k if k < 67 else 10_000) for k in range(70)], kinds)
    outputs = spark.createDataFrame([(1, 100, 500), (2, 100, 500), (1, 30, 500)], kinds)
    for bucket in (None, 20):
        for last, want in ((64, {(1, 100): 34, (2, 100): None, (1, 30): 0}), (3, {(1, 100): None, (2, 100): None, (1, 30): 0})):
            assert {(r.run, r.arr): r.age for r in timejoin.freshest_of(outputs, inputs, "run", "us", "arr", last, bucket).collect()} == want


def test_scale_and_agreement_without_weight_or_spread(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 0.0, 3.0), (1, 3, 4.0, 5.0)], "g int, k int, w double, r double")
    got = [r.scale for r in running.online_scale(d, ["g"], "k", "w", "r").orderBy("k").collect()]
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2] == 5.0
    d = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 4.0), (2, 3.0, 1.0), (3, None, None), (4, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: r.c for r in d.groupBy("g").agg(stats.correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert math.isnan(got[1]) and got[2] == pytest.approx(0.0) and got[3] is None and math.isnan(got[4])


def test_first_fit_lists_no_pairs_of_a_crowd(spark):
    """Against a plain walk, and 30,000 points on three places (some 150 million pairs before)."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), k, rng.uniform(0, 30), rng.choice([rng.uniform(0, 30), 4.0, 8.0])) for k in range(500)]
    got = {(r.g, r.k): r.cluster for r in sets.first_fit(spark.createDataFrame(rows, "g int, k int, x double, y double"), "g", "k", "x", "y", 4.0).collect()}
    for g in (0, 1):
        opened = []
        for _, k, x, y in (r for r in rows if r[0] == g):
            near = [o for o, a, b in opened if math.sqrt((x - a) ** 2 + (y - b) ** 2) <= 4.0]
            if not near:
                opened.append((k, x, y))
            assert got[g, k] == (near[0] if near else k)
    crowd = spark.range(30_000).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") % 3 * 10.0).alias("x"), F.lit(0.0).alias("y"))
    assert {tuple(r) for r in sets.first_fit(crowd, "g", "k", "x", "y", 4.0).groupBy("cluster").count().collect()} == {(0, 10_000), (1, 10_000), (2, 10_000)}


def test_figures_of_few_large_groups_are_those_of_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.gauss(0, 5) if rng.random() < 0.9 else None) for _ in range(500)] + [("c", "x", None)]
    d = spark.createDataFrame(rows, "g string, h string, e double")
    plain = d.groupBy("g", "h").agg(*stats.error_stats(F.col("e")))
    few = stats.error_stats_of_few(d, ["g", "h"], "e")
    assert few.columns == plain.columns and few.exceptAll(plain).isEmpty() and plain.exceptAll(few).isEmpty()
    assert "percentile(" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_estimates_do_not_grow_in_loops(spark):
    d = cut(spark.range(10).toDF("a"))
    for _ in range(6):
        d = cut(d.join(d.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).join(d.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).select("a"))
    assert d.count() == 10
    assert int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() <= 64


def test_a_cut_keeps_rows_and_types(spark):
    d = spark.sql("select 1L a, 1.50BD b, array(struct(1 x, null y)) c, timestamp'2024-01-01 00:00:00' d, map('k', 2.5D) e, cast(null as string) f, binary('z') g, date'2024-02-29' h")
    assert cut(d).dtypes == d.dtypes and cut(d).collect() == d.collect() and cut(d.limit(0)).collect() == []


def test_shared_cells_against_a_plain_count(spark):
    rng = random.Random(7)
    kinds = [[(rng.randrange(6), rng.choice([None, 0, 1, 2])) for _ in range(rng.randrange(1, 12))] for _ in range(15)]
    rows = [(key, *c) for key in range(60) for c in rng.choice(kinds)] + [(None, 1, 1)]
    d = spark.createDataFrame(rows, "k int, p int, q int")
    own = {k: {r[1:] for r in rows if r[0] == k} for k in range(60)}
    for least in (0.3, 0.5, 1.0):
        want = {}
        for a in own:
            for b in range(a + 1, 60):
                both, n = sum(None not in c for c in own[a] & own[b]), min(len(own[a]), len(own[b]))
                if both and both >= n * least:
                    want[a, b] = (both, both / n)
        got = [((r.a, r.b), (r.shared, r.ratio)) for r in sets.shared_cells(d, "k", ["p", "q"], least).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_keys_of_equal_sets_meet_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sets, "cut", lambda d: written.append(cut(d)) or written[-1])
    d = spark.range(300).selectExpr("id k", "explode(sequence(1 + id % 2 * 2, 8 + id % 2 * 2)) p", "0 q")
    assert sets.shared_cells(d, "k", ["p", "q"], 0.5).count() == 300 * 299 // 2
    assert written[-1].count() == 3
    assert sets.shared_cells(d, "k", ["p", "q"], 0.9).count() == 2 * (150 * 149 // 2)


def test_robust_lines_without_a_group_in_a_task(spark):
    d = spark.range(20_000).selectExpr("id % 2 g", "id % 50 * 1.0D x", "id % 50 * 3.0D + 7 + id % 11 * 0.25D + if(id % 100 = 1, 500, 0) y")
    d = d.unionByName(spark.createDataFrame([(5, 1.0, 2.0), (6, 1.0, 1.0), (6, 2.0, 2.0), (None, 1.0, 2.0)], "g long, x double, y double"))
    out = fitting.robust_regression(d, "g", "x", "y")
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.g: r for r in out.collect()}
    assert set(got) == {0, 1, 5, 6} and abs(got[0].slope - 3) < 0.01 and abs(got[1].slope - 3) < 0.01
    assert (got[0].n, got[1].n) == (10_000, 9_800) and (got[5].slope, got[5].n) == (None, 0) and got[6].n == 0


def test_sets_with_much_in_common_are_compared_in_blocks(spark, monkeypatch):
    """Lists of common cells would meet more than all pairs do: blocks of sets are compared instead, in several tasks, with the
    same pairs as lists give; keys of equal sets count each."""
    rng = random.Random(12)
    kept = {k: {(rng.randint(0, 4), int(rng.expovariate(0.5))) for _ in range(rng.randint(1, 30))} for k in range(120)}
    kept |= {200 + k: kept[k] for k in range(5)}
    rows = [(k, p, q) for k, s in kept.items() for p, q in s] + [(300, None, 1), (301, 0, None), (301, 0, 0), (None, 0, 0)]
    d = spark.createDataFrame(rows, "k long, p int, q int")
    sizes = {k: len(s) for k, s in kept.items()} | {301: 2}
    kept[301] = {(0, 0)}
    want = {(a, b): len(kept[a] & kept[b]) for a in kept for b in kept if a < b and 2 * len(kept[a] & kept[b]) >= min(sizes[a], sizes[b]) and kept[a] & kept[b]}
    done, compared = [], sets.compared
    monkeypatch.setattr(sets, "compared", lambda *a: done.append(1) or compared(*a))
    monkeypatch.setattr(sets, "BLOCK_CELLS", 300)
    for meeting in (50, 0):  # in blocks, in lists
        monkeypatch.setattr(sets, "MEETING", meeting)
        got = [((r.a, r.b), r.shared, round(r.ratio, 9)) for r in sets.shared_cells(d, "k", ["p", "q"], 0.5).collect()]
        assert sorted(got) == sorted((p, n, round(n / min(sizes[p[0]], sizes[p[1]]), 9)) for p, n in want.items())
        assert len(done) == 1
