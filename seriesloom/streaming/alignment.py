"""Alignment: where a run begins and which way it faces, from the fixes of its first stretch.

The window opens with a run's first valid fix and closes by event time.  Of the
fixes in it, those of the first antenna give the anchor: the last one if the
run has moved meanwhile, else the mean of those near their median (if none is
near, of the nearest).  The heading
comes from pairs of both antennas whose distance is plausible, or, without any,
from the way between the first and the last fix if that is long enough; else it
is null and the run is not ready.  Without the first antenna the other serves,
once it has been seen long enough.

In batch the window is a filter and a run's group holds one window; in a
stream the fixes wait in keyed state, and a timer at the window's end gives the
same row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import atan2, hypot
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "run long, start long, used long, x double, y double, way double, heading double, ready boolean, moving boolean, antenna string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class AlignRules:
    """Times in the unit of `us`, lengths in that of x and y."""

    window: int
    first: str = "master"
    second: str = "rover"
    second_only_after: int = 0
    tolerance: int = 0
    base: tuple[float, float] = (0.0, 1e9)
    moved: float = 0.3
    near: float = 20.0
    least_way: float = 5.0


def aligned(run: int, fixes: list[tuple], r: AlignRules) -> tuple | None:
    """The row of OUT for the fixes (us, antenna, x, y, way) of one window."""
    fixes = sorted(fixes)
    own, other = ([f for f in fixes if f[1] == a] for a in (r.first, r.second))
    if not own:
        if not other or other[-1][0] - other[0][0] < r.second_only_after:
            return None
        own, other = other, []
    last, first = own[-1], own[0]
    moving = max(f[4] for f in own) - min(f[4] for f in own) > r.moved
    x, y = last[2], last[3]
    if not moving:
        mx, my = median(f[2] for f in own), median(f[3] for f in own)
        away = [hypot(f[2] - mx, f[3] - my) for f in own]
        kept = [f for f, d in zip(own, away, strict=True) if d < r.near or d <= min(away) + 1e-6]
        x, y = sum(f[2] for f in kept) / len(kept), sum(f[3] for f in kept) / len(kept)
    pairs = [(b[2] - a[2], b[3] - a[3]) for a in own for b in other if abs(a[0] - b[0]) <= r.tolerance]
    pairs = [p for p in pairs if r.base[0] <= hypot(*p) <= r.base[1]]
    way = last[2] - first[2], last[3] - first[3]
    heading = atan2(sum(p[0] for p in pairs), sum(p[1] for p in pairs)) if pairs else atan2(*way) if hypot(*way) > r.least_way else None
    return run, fixes[0][0], len(fixes), x, y, last[4], heading, heading is not None, moving, own[0][1]


def valid(fixes: DataFrame) -> DataFrame:
    return fixes.where(" and ".join(f"{c} is not null" for c in ("run", "us", "antenna", "x", "y", "way")) + " and not isnan(x) and not isnan(y)")


def in_batch(fixes: DataFrame, r: AlignRules) -> DataFrame:
    """Rows of OUT for fixes (run, us, antenna, x, y, way); runs without an anchor have none."""
    start = F.min("us").over(Window.partitionBy("run"))
    inside = valid(fixes).withColumn("_start", start).where(F.col("us") <= F.col("_start") + r.window)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = aligned(key[0], list(pdf[["us", "antenna", "x", "y", "way"]].itertuples(index=False, name=None)), r)
        return pd.DataFrame([row] if row else [], columns=NAMES)

    return inside.select("run", "us", "antenna", "x", "y", "way").groupBy("run").applyInPandas(run, OUT)


def in_stream(fixes: DataFrame, r: AlignRules, late: str = "0 seconds") -> DataFrame:
    """The same for a streaming df; a fix later than `late` may be missed, and a run is aligned once.

    A fix that comes before the window has closed and lies before its start moves the window there.
    """
    rows = valid(fixes).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        held, done = json.loads(state.get[0]) if state.exists else ([], False)
        if not state.hasTimedOut:
            for pdf in frames:
                if not done:
                    held += [[int(u), a, float(x), float(y), float(w)] for u, a, x, y, w in pdf[["us", "antenna", "x", "y", "way"]].itertuples(index=False, name=None)]
        out = []
        if held:
            start = min(f[0] for f in held)
            held = [f for f in held if f[0] <= start + r.window]
            if state.hasTimedOut or state.getCurrentWatermarkMs() * 1000 > start + r.window:
                row = aligned(key[0], [tuple(f) for f in held], r)
                out, held, done = [row] if row else [], [], True
            else:
                state.setTimeoutTimestamp((start + r.window) // 1000 + 1)
        state.update((json.dumps([held, done]),))
        yield pd.DataFrame(out, columns=NAMES)

    return rows.groupBy("run").applyInPandasWithState(run, OUT, "state string", "append", "EventTimeTimeout")
