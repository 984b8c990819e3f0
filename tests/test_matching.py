"""Routes, places, anchors and projections against plain walks over small maps."""

import math
import random

import pytest

from seriesloom.operators import projection, routes
from seriesloom.operators.folds import fold


def interp(points, s):
    points = sorted(points)
    s = min(max(s, points[0][0]), points[-1][0])
    for (s0, x0, y0), (s1, x1, y1) in zip(points, points[1:], strict=False):
        if s0 <= s <= s1:
            return x0 + (x1 - x0) * (s - s0) / (s1 - s0), y0 + (y1 - y0) * (s - s0) / (s1 - s0)


def town(seed):
    """Eight paths, links with counts, among them a dead end and a fork."""
    rng = random.Random(seed)
    paths = {p: [(0.0, 0.0, float(p))] for p in range(8)}
    for p, pts in paths.items():
        for _ in range(rng.randint(1, 5)):
            s, x, y = pts[-1]
            pts.append((s + rng.randint(5, 20), x + rng.uniform(1, 9), y + rng.uniform(-4, 4)))
    links = [(p, q, n, rng.randint(0, n), float(rng.choice([0, 6, 15]))) for p in range(7) for q in rng.sample(range(8), rng.choice([1, 2, 3])) for n in [rng.randint(0, 40)]]
    links = [x for i, x in enumerate(links) if not any(x[:2] == y[:2] for y in links[:i])]
    return paths, links


def walk(paths, links, start, s0, reach, stands):
    out, path, base, k = [], start, -s0, 0
    while True:
        end = base + paths[path][-1][0]
        options = [x for x in links if x[0] == path]
        out.append((k, path, base, not options))
        if not options or reach <= end:
            return out
        best = None
        for _, q, n, stood, window in options:
            p = (stood + 0.5) / (n + 1)
            here = any(end - window <= o <= end for o in stands)
            key = (round(math.log(n + 0.5) + math.log(p if here else 1 - p), 9), -q)
            best = max(best or (key, q), (key, q))
        path, base, k = best[1], end, k + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_and_places(spark, seed):
    rng, (paths, links) = random.Random(seed), town(seed)
    starts = [(run, run % 8, float(rng.randint(0, 4))) for run in range(12)]
    odo = [(run, i, rng.uniform(-3, 260) if i else 10.0) for run in range(13) for i in range(20)] + [(3, 99, None), (None, 1, 5.0)]
    stands = [(run, rng.uniform(0, 250)) for run in range(12) for _ in range(15)]
    points = spark.createDataFrame([(p, *x) for p, pts in paths.items() for x in pts], "path long, s double, x double, y double").repartition(3)
    rows = spark.createDataFrame(odo, "run long, i long, odo double")
    got = routes.routes(
        spark.createDataFrame(starts, "run long, path long, s double"), points, spark.createDataFrame(links, "path long, next long, n long, stood long, window double"), rows, spark.createDataFrame(stands, "run long, odo double")
    )
    want = {}
    for run, path, s in starts:
        way = walk(paths, links, path, s, max(o for r, _, o in odo if r == run and o is not None), [o for r, o in stands if r == run])
        want |= {(run, k): (p, round(b, 6), e) for k, p, b, e in way}
    assert {(r.run, r.k): (r.path, round(r.base, 6), r.ends) for r in got.collect()} == want
    assert any(e for _, _, e in want.values())
    for buckets in ((None, None), (30.0, 7.0)):
        placed = {(r.run, r.i): r for r in routes.advance(rows, got, points, *buckets).collect()}
        assert len(placed) == len(odo)
        for run, i, o in odo:
            r = placed[run, i]
            if o is None or run in (None, 12):
                assert r.path is None and r.s is None and r.x is None
                continue
            _, (path, base, ends) = max((k, v) for (q, k), v in want.items() if q == run and (k == 0 or v[1] <= o))
            long_ = paths[path][-1][0]
            assert r.path == path and r.s == pytest.approx(min(max(o - base, 0), long_)) and r.hold == pytest.approx(max(o - base - long_, 0))
            assert r.hold == 0 or ends
            assert (r.x, r.y) == pytest.approx(interp(paths[path], r.s))


def test_a_dead_end_holds_and_lets_go(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 10.0), (1, 20.0, 10.0, 10.0)], "path long, s double, x double, y double")
    rows = spark.createDataFrame([(7, i, o) for i, o in enumerate([5.0, 19.0, 26.0, 21.0, 12.0])], "run long, i long, odo double")
    none = spark.createDataFrame([], "path long, next long, n long, stood long, window double")
    route = routes.routes(spark.createDataFrame([(7, 1, 0.0)], "run long, path long, s double"), points, none, rows, spark.createDataFrame([], "run long, odo double"))
    got = [(r.s, r.hold, r.x, r.y, round(r.heading, 6)) for r in routes.advance(rows, route, points).orderBy("i").collect()]
    east = round(math.pi / 2, 6)
    assert got == [(5.0, 0.0, 0.0, 5.0, 0.0), (19.0, 0.0, 9.0, 10.0, east), (20.0, 6.0, 10.0, 10.0, east), (20.0, 1.0, 10.0, 10.0, east), (12.0, 0.0, 2.0, 10.0, east)]
    with pytest.raises(ValueError):
        routes.routes(spark.createDataFrame([(7, 1, 0.0)], "run long, path long, s double"), points.unionByName(spark.createDataFrame([(2, 0.0, 0.0, 0.0)], points.schema)), spark.createDataFrame([(1, 2, 1, 0, 0.0)], none.schema), rows, rows.select("run", "odo"))


def test_anchors(spark):
    """A stand near a stop is tied to it, a queue far before one is not, and the shift carries on."""
    route = spark.createDataFrame([(1, 0, 5, -10.0, 100.0, False), (1, 1, 6, 90.0, 200.0, True)], "run long, k long, path long, base double, length double, ends boolean")
    stops = spark.createDataFrame([(5, 40.0, 1.0), (5, 95.0, 1.0), (6, 60.0, 1.0), (6, 250.0, 1.0)], "path long, s double, sd double")  # at 30, 85, 150 of the odometer; the last lies beyond the path
    stands = spark.createDataFrame([(1, 10, 33.0), (1, 20, 60.0), (1, 30, 91.0), (1, 40, 151.0), (1, 50, None), (2, 1, 33.0)], "run long, us long, odo double")
    found = routes.anchors(stands, route, stops, routes.AnchorRules(sigma=2.0, growth=0.01, most=50.0))
    assert sorted((r.odo, r.moved, r.shift) for r in found.collect()) == [(33.0, -3.0, -3.0), (91.0, -3.0, -6.0), (151.0, 5.0, -1.0)]
    rows = spark.createDataFrame([(1, o) for o in (10.0, 33.0, 90.0, 160.0)], "run long, odo double")
    assert sorted(r.odo for r in routes.anchored(rows, found).collect()) == [10.0, 30.0, 87.0, 159.0]
    assert routes.anchors(stands, route, stops, routes.AnchorRules(most=0.5)).count() == 0


def line(spark, xy, name="x double, y double"):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], f"run long, us long, {name}")


def test_along_cross_on_a_straight_line(spark):
    ref = line(spark, [(x, 0) for x in range(0, 1001)])
    est = line(spark, [(x + 3, 1.5) for x in range(0, 1001)]).where("us % 10 = 0")
    got = projection.along_cross(ref, est).collect()
    assert len(got) == 101
    assert all(r.along == pytest.approx(3.0) and r.cross == pytest.approx(1.5) and r.s_ref == pytest.approx(r.us) for r in got)


def test_along_cross_rules(spark):
    """There and back on parallel tracks 4 apart: the opposite way is never taken, nor a place far off; of two near-equal feet the nearer along the track."""
    there, back = [(x, 0) for x in range(0, 200)], [(x, 4) for x in range(200, -1, -1)]
    ref = line(spark, there + [(202, 2)] + back)
    est = line(spark, [(x, 3.0) for x, _ in there] + [(202, 2)] + [(x, 0.5) for x, _ in back])
    got = {r.us: r for r in projection.along_cross(ref, est).collect()}
    assert got[100].cross == pytest.approx(3.0) and abs(got[100].along) < 1e-6
    assert got[300].cross == pytest.approx(3.5) and abs(got[300].along) < 1e-6
    far = projection.along_cross(ref, line(spark, [(x, 90.0) for x, _ in there])).collect()
    assert all(r.along is None and r.cross is None and r.s_ref is not None for r in far)
    assert projection.along_cross(ref.limit(1), est.limit(1)).first().along is None


def test_thinning_and_prolonging(spark):
    segs = projection.track(line(spark, [(0, 0), (0.4, 0), (1, 0), (1, 0.9), (1, 2), (None or 1, 3.5)]), 1.0, 50.0).orderBy("seg").collect()
    assert [(r.ax, r.ay, r.ex, r.ey, r.s) for r in segs] == [(-50, 0, 0, 0, -50), (0, 0, 1, 0, 0), (1, 0, 1, 2, 1), (1, 2, 1, 3.5, 3), (1, 3.5, 1, 53.5, 4.5)]


def brute(paths, px, py, yaw):
    best = None
    for path, pts in sorted(paths.items()):
        own, s = None, 0.0
        for i, (a, b) in enumerate(zip(pts, pts[1:], strict=False)):
            dx, dy = b[0] - a[0], b[1] - a[1]
            n = math.hypot(dx, dy)
            raw = ((px - a[0]) * dx + (py - a[1]) * dy) / n
            t = min(max(raw, 0), n)
            d = math.hypot(px - a[0] - t * dx / n, py - a[1] - t * dy / n)
            if own is None or round(d, 9) < round(own[0], 9):
                own = (d, s + t, math.atan2(dy, dx), (i == 0 and raw < -0.5) or (i == len(pts) - 2 and raw > n + 0.5))
            s += n
        if yaw is None or math.cos(own[2] - yaw) > 0:
            best = min(best or (own[0], path, own), (own[0], path, own))
    return best and (best[1], best[2][1], best[0], best[2][3])


def test_match_graph(spark):
    rng = random.Random(4)
    paths = {p: [(rng.uniform(-200, 200), rng.uniform(-200, 200)) for _ in range(rng.randint(2, 6))] for p in range(9)}
    probes = [(k, rng.uniform(-900, 900), rng.uniform(-300, 300), rng.choice([None, rng.uniform(-4, 4)])) for k in range(80)]
    points = spark.createDataFrame([(p, i, x, y, 1.0) for p, pts in paths.items() for i, (x, y) in enumerate(pts)], "path long, pos long, x double, y double, z double")
    df = spark.createDataFrame([*probes, (999, None, 1.0, None)], "k long, px double, py double, yaw double")
    got = {r.k: r for r in projection.match_graph(df, points, 15.0).collect()}
    assert len(got) == 81 and got[999].path is None
    for k, px, py, yaw in probes:
        want = brute(paths, px, py, yaw)
        assert (got[k].path is None) == (want is None)
        if want:
            assert got[k].path == want[0] and got[k].s == pytest.approx(want[1]) and got[k].dist == pytest.approx(want[2]) and got[k].beyond == want[3]
    assert projection.match_graph(df, points.limit(0), 15.0).where("path is not null").count() == 0


def test_path_graph_cross_and_along(spark):
    """Half a unit to the left and two ahead on a path; the way behind its end is told; the opposite path is not taken."""
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 400.0, 0.0, 5.0), (1, 0, 400.0, 3.5, 2.0), (1, 1, 0.0, 3.5, 2.0)], "path long, pos long, x double, y double, z double")
    df = spark.createDataFrame([(k, -100.0 + k + 2, 0.5, 0.0) for k in range(0, 600, 7)] + [(1000 + k, 400.0 - k, 0.5, math.pi) for k in range(0, 400, 9)], "k long, px double, py double, yaw double")
    got = {r.k: r for r in projection.match_graph(df, points, 20.0).collect()}
    for k, r in got.items():
        if k < 1000:
            x = -98.0 + k
            assert r.path == 0 and r.lat == pytest.approx(0.5) and r.s == pytest.approx(min(max(x, 0), 400)) and r.beyond == (not -0.5 <= x <= 400.5)
        else:
            assert r.path == 1 and r.lat == pytest.approx(3.0) and r.s == pytest.approx(k - 1000)


def test_along_cross_where_the_reference_stands(spark):
    """Equal places one after another, at the begin, between and at the end, are segments without length."""
    at = [0.0, 0.0, 0.0, 0.0, 10.0, 20.0, 20.0, 20.0, 20.0, 30.0, 40.0, 40.0, 40.0]
    ref = spark.createDataFrame([(1, k, x, 0.0) for k, x in enumerate(at)], "run int, us long, x double, y double")
    est = spark.createDataFrame([(1, k, x + 2, 3.0) for k, x in enumerate(at)], "run int, us long, x double, y double")
    got = {r.us: r for r in projection.along_cross(ref, est, least=0.0).collect()}
    assert len(got) == len(at) and all(got[k].s_ref == pytest.approx(x) for k, x in enumerate(at))
    for k, x in enumerate(at):
        # before a stand the end of a segment is a foot too, and behind the last one no line goes on
        along, cross = (0.0, math.hypot(2, 3)) if x in (20.0, 40.0) else (2.0, 3.0)
        assert (got[k].along, got[k].cross) == (pytest.approx(along), pytest.approx(cross)), k


def test_stops_of_a_long_path_are_not_listed_for_every_run(spark, monkeypatch):
    stops = spark.range(20_000).selectExpr("1L path", "id * 10.0D s", "1.0D sd")
    route = spark.range(100).selectExpr("id run", "0L k", "1L path", "0.0D base", "199990.0D length")
    stands = spark.range(100).selectExpr("id run", "0L us", "1000.0D + id % 4 odo")
    met = []
    monkeypatch.setattr(routes, "fold", lambda d, *more: met.append(d) or fold(d, *more))
    found = routes.anchors(stands, route, stops, routes.AnchorRules(sigma=2.0, growth=0.0, most=40.0))
    assert [r.shift for r in found.orderBy("run").collect()] == [(0.0, -1.0, -2.0, -3.0)[k % 4] for k in range(100)]
    assert met[0].selectExpr("max(size(stops))").first()[0] <= 9
