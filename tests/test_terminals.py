"""Planar clusters, passages and branches against plain versions."""

from statistics import median

import numpy as np
import pytest

from seriesloom.operators import clusters, sets, terminals
from seriesloom.operators.clusters import linked_in_plane

POINT = "k long, g long, x double, y double"


def plain_clusters(points, link):
    label = {(g, k): k for k, g, _, _ in points}
    moved = True
    while moved:
        moved = False
        for k, g, x, y in points:
            for j, h, u, v in points:
                if g == h and np.sqrt((u - x) * (u - x) + (v - y) * (v - y)) <= link and label[g, j] < label[g, k]:
                    label[g, k], moved = label[g, j], True
    return label


@pytest.mark.parametrize("direct", [1024, 0])
def test_planar_clusters(spark, direct):
    """Compared point by point and by halving boxes; keys repeat in other groups, places repeat, some are unknown."""
    r = np.random.default_rng(5)
    points = [(k // 2, k % 2, float(x), float(y)) for k, (x, y) in enumerate(r.normal(0, 6, (240, 2)).round(1))]
    points += [(900, 0, points[0][2], points[0][3]), (901, 1, -1000.0, 5.0)]
    unknown = [(902, 0, None, 1.0), (903, None, 1.0, 1.0), (904, 0, float("nan"), 1.0), (None, 0, 1.0, 1.0), (905, 1, float("inf"), 0.0)]
    got = linked_in_plane(spark.createDataFrame(points + unknown, POINT), "k", "x", "y", 1.0, "g", direct)
    assert {(p.g, p.k): p.cluster for p in got.collect()} == plain_clusters(points, 1.0)


def test_two_crowds_just_out_of_reach(spark):
    """Two walls of 300 places each, 1.001 apart: no pair is near enough, and boxes say so only when small."""
    points = [(k + 1000 * side, 0, 1.001 * side - 0.0001 * (k % 3) * (1 - side), 0.002 * k) for side in (0, 1) for k in range(300)]
    d = spark.createDataFrame(points, POINT)
    assert {p.cluster for p in linked_in_plane(d, "k", "x", "y", 1.0, direct=64).collect()} == {0, 1000}
    assert {p.cluster for p in linked_in_plane(d, "k", "x", "y", 1.001, direct=64).collect()} == {0}


def test_crowded_cells_take_few_steps(spark, monkeypatch):
    """A line of forty crowded cells, a wall just within reach of it and one just out of reach: each cut costs the driver
    several jobs, so that they must not count the halvings of a crowd or the rounds along a line."""
    line = [(k, 0, 0.014 * k, 0.0003 * (k % 7)) for k in range(2000)]
    walls = [(k, 0, x, 0.0015 * (k % 1000 - 300)) for first, x in ((3000, -1.0), (5000, 28.987)) for k in range(first, first + 600)]
    cuts = []
    for module in (clusters, sets):
        monkeypatch.setattr(module, "cut", lambda d, real=module.cut: cuts.append(1) or real(d))
    got = linked_in_plane(spark.createDataFrame(line + walls, POINT), "k", "x", "y", 1.0)
    assert len(cuts) <= 12
    assert {(p.k // 1000, p.cluster) for p in got.collect()} == {(0, 0), (1, 0), (3, 0), (5, 5000)}


@pytest.mark.parametrize("held", [1, 3, 50])
def test_links_of_more_than_one_task(spark, monkeypatch, held):
    """Trees are handed on when a task holds so many nodes."""
    monkeypatch.setattr(clusters, "HELD", held)
    r = np.random.default_rng(8)
    points = [(k // 2, k % 2, float(x), float(y)) for k, (x, y) in enumerate(r.normal(0, 9, (240, 2)).round(1))]
    got = linked_in_plane(spark.createDataFrame(points, POINT), "k", "x", "y", 1.5, "g")
    assert {(p.g, p.k): p.cluster for p in got.collect()} == plain_clusters(points, 1.5)


def test_no_points(spark):
    assert linked_in_plane(spark.createDataFrame([], POINT), "k", "x", "y", 1.0).count() == 0


def test_passages_and_arrivals(spark):
    """Runs cross the circle, begin in it, end in it, or only touch it; buckets do not show."""
    xs = {
        1: [-9, -5, -1, 0, 1, 5, 9, 2, 1],  # through, and back to end inside
        2: [0, 1, 8, 9],  # begins inside
        3: [-9, -8, -7],  # stays out
        4: [9, 1],  # ends inside
        6: [7, 6, -2.5],  # ends inside, elsewhere
        5: [],
    }
    rows = [(run, k, 10 * k, float(x), 0.0) for run, path in xs.items() for k, x in enumerate(path)]
    rows += [(7, 0, None, 0.0, 0.0), (None, 0, 5, 0.0, 0.0)]
    track = spark.createDataFrame(rows, "run long, seq long, us long, x double, y double")
    at = spark.createDataFrame([(77, 0.0, 0.0)], "centre long, x double, y double")
    want = {(1, 2, 5, False), (1, 7, 9, True), (4, 1, 2, True), (6, 2, 3, True)}
    for bucket in (15, 10_000):
        numbered = terminals.numbered(track, bucket)
        assert {(r.run, r.us // 10 + 1, len(xs[r.run])) for r in numbered.collect()} == {(r.run, r.i, r.n) for r in numbered.collect()}
        found = terminals.passages(numbered, at, 3.0)
        assert {(r.run, r.first, r.last, r.ends) for r in found.collect()} == want
    main = terminals.arrivals(found, numbered, 1.0)
    assert {(r.run, r.main) for r in main.collect()} == {(1, True), (4, True), (6, False)}


def test_centres(spark):
    rows = [(run, 0, 0, 0.1 * run, 0.0) for run in range(4)] + [(run, 1, 9, 50.0 + 9 * run, 0.0) for run in range(3)]
    numbered = terminals.numbered(spark.createDataFrame(rows, "run long, seq long, us long, x double, y double"), 5)
    (found,) = terminals.centres(numbered, 1.0, 3).collect()
    # the fourth run has one row, which is both its ends
    assert (found.centre, found.runs, found.n, round(found.x, 9)) == (0, 4, 5, 0.18)


# ---- branches


def plain_branches(tracks, stands, r):
    """The same, passage after passage and row after row."""
    members = []
    for p in sorted(tracks):
        t = tracks[p]
        held = [j for j, row in enumerate(t) if row[5]]
        if not held:
            continue
        h = held[0]
        hx, hy, s_hold = t[h][3], t[h][4], t[h][0]
        if t[-1][0] - s_hold < r.more or np.hypot(t[-1][1] - hx, t[-1][2] - hy) < r.away:
            continue
        d = [np.hypot(x - cx, y - cy) for _, x, y, cx, cy, _ in t[: h + 1]]
        if len(d) >= 11:
            padded = [d[0]] * 5 + d + [d[-1]] * 5
            d = [median(padded[j : j + 11]) for j in range(len(d))]
        close = [j for j, x in enumerate(d) if x <= r.apart]
        since = min(close[-1] + 1, h) if close else 0
        s0 = t[since][0]
        steps = {}
        for s, x, y, *_ in t[since:]:
            steps.setdefault(int((s - s0) // r.step), []).append((s - s0, x, y))
        axis = np.array([np.mean(steps[q], axis=0) for q in sorted(steps)])
        if len(axis) >= 5:
            for c in (1, 2):
                v = np.r_[[axis[0, c]] * 2, axis[:, c], [axis[-1, c]] * 2]
                axis[:, c] = [v[j : j + 5].mean() for j in range(len(axis))]
        off_axis = [np.hypot(x - np.interp(s - s0, axis[:, 0], axis[:, 1]), y - np.interp(s - s0, axis[:, 0], axis[:, 2])) for s, x, y, *_ in t[since:]]
        members.append({"p": p, "hold": (hx, hy), "s_hold": s_hold, "off": s_hold - s0, "axis": axis, "noise": round(float(np.percentile(off_axis, 90)), 9)})
    dead = []
    for m in members:
        home = next((e for e in dead if np.hypot(e[0]["hold"][0] - m["hold"][0], e[0]["hold"][1] - m["hold"][1]) <= r.hold_join), None)
        dead.append([m]) if home is None else home.append(m)
    out = set()
    for end in dead:
        found = []
        for m in sorted(end, key=lambda m: (m["noise"], m["p"])):
            part = m["axis"][m["axis"][:, 0] >= m["off"] + r.past][:, 1:]
            for b in found:
                near = sum(np.hypot(*(b[0]["axis"][:, 1:] - q).T).min() <= r.axis_join for q in part)
                if len(part) and 10 * near >= 9 * len(part):
                    b.append(m)
                    break
            else:
                found.append([m])
        window = max(max(b[0]["off"] for b in found) + r.margin, r.window)
        for b in found:
            stood = sum(any(q == m["p"] and m["s_hold"] - window <= s <= m["s_hold"] + r.past for q, s in stands) for m in b)
            out.add((end[0]["p"], b[0]["p"], round(b[0]["off"], 6), round(window, 6), len(b), stood))
    return out


def ways():
    """A line from -150 to a dead end at 0, and from one to a second at (0, 90); some leave it before the end, some after, some not at all."""
    rng, tracks = np.random.default_rng(2), {}
    for p in range(14):
        kind, base, rows = p % 7, 90.0 * (p == 12), []
        for s in np.arange(0, 240, 3.0) + rng.uniform(0, 1):
            x, y, o = s - 150, 0.0, s - 150
            if kind in (1, 2) and o > 0:  # straight on, the second a little beside
                y = 1.5 * (kind - 1)
            if kind == 3 and o > -40:  # leaves before the end
                x, y = -40 + (o + 40) * 0.6, (o + 40) * 0.8
            if kind == 4 and o > 0:  # a loop to the other side
                x, y = 25 * np.sin(o / 25), 25 * np.cos(o / 25) - 25
            if kind == 5:  # halts
                x = min(x, 4.0)
            if kind == 6 and o > 0:
                x, y = o * 0.6, o * 0.8
            e = rng.normal(0, 0.3, 2)
            rows.append((float(s), float(x + e[0]), float(base + y + e[1]), float(min(o, 0)), base, bool(o > 0)))
        tracks[p] = rows
    tracks[14] = tracks[1][:20]  # never there
    tracks[15] = tracks[1][48:56]  # few rows, and soon gone
    return tracks


def test_branches(spark):
    tracks, r = ways(), terminals.BranchRules()
    stands = [(1, 140.0), (2, 30.0), (3, 120.0), (3, 121.0), (8, 160.0), (9, 400.0), (4, 100.0), (5, 150.0)]
    rows = [(p, i, *row) for p, t in tracks.items() for i, row in enumerate(t)]
    shape = "passage long, i long, s double, x double, y double, cx double, cy double, held boolean"
    points = spark.createDataFrame(rows + [(3, 999, None, 0.0, 0.0, 0.0, 0.0, True), (None, 1, 1.0, 0.0, 0.0, 0.0, 0.0, True)], shape)
    found, axes = terminals.branches(points, spark.createDataFrame(stands, "passage long, s double"), r)
    got = {(b.dead_end, b.branch, round(b.off, 6), round(b.window, 6), b.n, b.stood) for b in found.collect()}
    want = plain_branches(tracks, stands, r)
    assert got == want and len(got) >= 4 and any(b[4] > 2 for b in got)
    assert {a.branch for a in axes.select("branch").distinct().collect()} == {b[1] for b in got}


def test_branches_open_many_a_round(spark, monkeypatch):
    """Thirty rays behind one dead end, each its own branch, some of two passages and some of copies: in rounds of a few and in rounds of many."""
    tracks, r = {}, terminals.BranchRules()
    for p in range(42):
        turn, e = (p % 30) * np.pi / 31 - 1.5, np.random.default_rng(p).normal(0, 0.2, (80, 2)).tolist()
        way = [3.0 * k - 60.0 for k in range(80)]
        tracks[p + 50] = tracks[p] = [(o + 60.0, (o if o <= 0 else o * float(np.cos(turn))) + float(a), (0.0 if o <= 0 else o * float(np.sin(turn))) + float(b), min(o, 0.0), 0.0, o > 0) for o, (a, b) in zip(way, e, strict=True)]
    rows = [(p, i, *row) for p, t in tracks.items() for i, row in enumerate(t)]
    points = spark.createDataFrame(rows, "passage long, i long, s double, x double, y double, cx double, cy double, held boolean")
    stands = spark.createDataFrame([], "passage long, s double")
    want, cuts, real = plain_branches(tracks, [], r), [], terminals.cut
    assert len(want) >= 20
    monkeypatch.setattr(terminals, "cut", lambda d: cuts.append(1) or real(d))
    for tried in (terminals.TRIED, (4, 16)):
        cuts.clear()
        monkeypatch.setattr(terminals, "TRIED", tried)
        found, _ = terminals.branches(points, stands, r)
        assert {(b.dead_end, b.branch, round(b.off, 6), round(b.window, 6), b.n, b.stood) for b in found.collect()} == want
        assert len(cuts) < 48  # a round cuts six times


def test_no_branches(spark):
    shape = "passage long, i long, s double, x double, y double, cx double, cy double, held boolean"
    found, axes = terminals.branches(spark.createDataFrame([], shape), spark.createDataFrame([], "passage long, s double"))
    assert found.count() == 0 and axes.count() == 0


def test_clusters_carry_no_estimates_of_their_rounds(spark):
    line = spark.range(200).selectExpr("id key", "id * 1.0D x", "0.0D y")
    out = linked_in_plane(line, "key", "x", "y", 1.0)
    assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 1000
    assert {r.cluster for r in out.collect()} == {0}
