"""Slips against an automaton that goes through the rows one by one."""

import random

import pytest

from seriesloom.operators.slips import SlipRules, halo, slips

R = SlipRules(("a", "b", "c"), live=5, longest=20, jump=10, least_share=0.1, least_value=3, standstill=2, moving=4, returns=4, settled=2, agree=9, noise_time=6, noise_weight=2.0)


def automaton(rows, r):
    """(us, sign, size, end, how) of one run's readings (us, seq, axle, z, expected, ok)."""
    out, last, jump, changes, slip, ended = [], {}, {}, [], None, float("-inf")
    since, timeout, ok_before = None, (0, float("-inf")), False
    for us, _seq, axle, z, h, ok in sorted(rows):
        before = last.get(axle)
        dz = z - before[1] - (h - before[2]) if before and us - before[0] <= r.live else None
        side = 0 if dz is None or abs(dz) < r.jump else 1 if dz > 0 else -1
        last[axle] = (us, z, h)
        if side:
            jump[axle] = (us, side, abs(dz))
        elif dz is not None:
            changes.append((us, abs(dz)))
        near = [c for t, c in changes if us - t <= r.noise_time]
        noise = sum(near) / len(near) if near else None
        if ok and not ok_before:
            since = us
        ok_before = ok
        live = [a for a, x in last.items() if us - x[0] <= r.live]
        v = sum(last[a][2] for a in live) / len(live)
        still = all(last[a][1] < r.standstill for a in live)
        if slip:
            sign, begin, size, high, home = slip
            if side == -sign:
                home.add(axle)
            if dz is not None and -sign * dz > r.returns:
                high.add(axle)
            if dz is not None and -sign * dz < r.settled and axle in high:
                home.add(axle)
            how = (
                "timeout" if us - begin > r.longest else "zeros" if still and v > r.moving else "noise" if noise is not None and r.jump + r.noise_weight * noise >= size
                else "back" if all(a in home for a in live) else "agree" if ok and us - max(since, begin) >= r.agree else None
            )
            if how:
                out.append((begin, sign, size, us, how))
                slip, ended = None, us
                if how == "timeout":
                    timeout = (sign, us)
            continue
        jumps = [jump.get(a) for a in live]
        if len(live) < 2 or not all(j and us - j[0] <= r.live for j in jumps):
            continue
        sign, size, oldest = jumps[0][1], min(j[2] for j in jumps), min(j[0] for j in jumps)
        if not all(j[1] == sign and sign * (last[a][1] - last[a][2]) > 0 for a, j in zip(live, jumps, strict=True)):
            continue
        if size < r.least_share * v or v <= r.least_value or still or oldest <= ended or (timeout[0] == -sign and us - timeout[1] <= r.longest):
            continue
        slip = (sign, us, size, set(), set())
    if slip:
        out.append((slip[1], slip[0], slip[2], None, None))
    return out


def readings(seed, n):
    """A body whose wheels now and then all leave it, come back at once, slowly or never, stand still or get noisy."""
    rng, rows, us, v = random.Random(seed), [], 0, 30.0
    off, back, noisy = {a: 0.0 for a in R.axles}, None, 0
    for seq in range(n):
        us += rng.choice([1, 1, 1, 2, 3]) if rng.random() < 0.99 else 40
        v = min(max(v + rng.uniform(-1, 1), 8.0), 60.0)
        x = rng.random()
        if x < 0.02:
            s = rng.choice([1, -1]) * rng.choice([14, 18, 25])
            off, back = {a: s for a in R.axles}, rng.choice([None, "step", "slow", "slow", "accepted"])
        elif x < 0.03:
            off = {a: -v for a in R.axles}
        elif x < 0.05:
            noisy = 12
        elif x < 0.12 and back == "step":
            off, back = {a: 0.0 for a in R.axles}, None
        a = rng.choice(R.axles)
        if back == "slow":
            off[a] = off[a] * 0.6 if abs(off[a]) > 1 else 0.0
        noisy -= 1
        z = round(v + off[a] + rng.uniform(-1, 1) * (9 if noisy > 0 else 0.5), 3)
        rows.append((us, seq, a, z, round(v, 3), abs(z - v) < 6 or back == "accepted"))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(60, 1), (1000, 2), (10**9, 3)])
def test_slips(spark, width, seed):
    runs = {run: readings(seed * 10 + run, 700) for run in range(4)}
    want = sorted(str((run, *x)) for run, rows in runs.items() for x in automaton(rows, R))
    df = spark.createDataFrame([(run, us, seq, a, z, h, ok) for run, rows in runs.items() for us, seq, a, z, h, ok in rows], "run long, us long, seq long, axle string, z double, expected double, ok boolean").repartition(5)
    got = slips(df, R, width).collect()
    assert sorted(str((r.run, r.us, r.sign, r["size"], r.end, r.how)) for r in got) == want
    assert len({r.how for r in got}) >= 3


def test_halo(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 9, 10, 25, None)], "run long, us long")
    got = sorted((r.us, r._bucket, r._own) for r in halo(df, ["run"], "us", 10, 4).collect())
    assert got == [(0, 0, True), (9, 0, True), (9, 1, False), (10, 1, True), (25, 2, True)]


def test_empty(spark):
    df = spark.createDataFrame([], "run long, us long, seq long, axle string, z double, expected double, ok boolean")
    assert slips(df, R, 50).count() == 0
