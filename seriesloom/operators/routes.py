"""Map matching on a path graph: which paths a run takes, and where on them it is by its own way.

The map is a table of points along paths and a table of links from a path's
end to the next ones.  A run has a starting place and an odometer.

* `routes` unrolls the paths of all runs together, a link of every run a round
  of joins.  Where a path has several followers, each is a hypothesis: its
  passages so far, and how many of them stood shortly before the end, against
  whether this run stood there.  A path without followers is a dead end.
* `advance` lays any number of odometer rows on the route: two as-of joins, on
  the odometer and on the arc length; no row looks at a whole line, and a
  popular path is split by arc length.  At a dead end the place holds while
  the odometer goes on, and leaves again when it has come back.  Of paths that
  begin at one odometer (a start at a path's very end) the last counts.
* `anchors` ties stands to known stops within three sigma along the route; a
  fold over stands only, as each depends on the shift before.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timejoin
from .folds import Fold, fold, output
from .lineage import cut


def lengths(points: DataFrame) -> DataFrame:
    """path, length of points (path, s, ...), s being arc length from the path's begin."""
    return points.where("path is not null and s is not null").groupBy("path").agg(F.max("s").alias("length"))


def routes(starts: DataFrame, points: DataFrame, links: DataFrame, odometer: DataFrame, stands: DataFrame) -> DataFrame:
    """run, k, path, base, length, ends: the paths of each run in order; on path the run is at arc length odo - base.

    starts: run, path, s at odometer 0.  links: path, next, n, stood, window: n passages, `stood` of which stood within
    `window` before the path's end.  stands: run, odo.  Of several followers the one with the largest
    ln(n + 1/2) + ln(p), or ln(1 - p) if the run did not stand there, is taken, p = (stood + 1/2) / (n + 1); the smallest
    of equal ones.  A run goes on as long as its odometer passes the end.  ends: whether the path is a dead end.  Every
    path that a link leads to must be longer than nothing.
    """
    long_ = cut(lengths(points))
    known = links.where("path is not null and next is not null").join(long_.select(F.col("path").alias("next"), F.col("length").alias("_length")), "next")
    known = cut(known)
    if not known.where("_length <= 0").isEmpty():
        raise ValueError("a link leads to a path without length")
    widest = known.agg(F.max("window")).first()[0] or 0.0
    width = max(float(widest), 1e-9)
    reach = odometer.where("run is not null").groupBy("run").agg(F.max("odo").alias("reach"))
    rests = cut(stands.select("run", "odo", F.floor(F.col("odo") / width).alias("_b")).where("run is not null and odo is not null"))
    exits = known.select("path").distinct().withColumn("_goes", F.lit(True))
    front = starts.join(long_, "path").join(reach, "run").select("run", F.lit(0).cast("long").alias("k"), "path", (-F.col("s")).alias("base"), "length", "reach")
    front = cut(front.join(exits, "path", "left"))
    parts = [front]
    while True:
        leaving = front.where("_goes and reach > base + length").withColumn("at", F.col("base") + F.col("length"))
        if leaving.isEmpty():
            break
        options = leaving.select("run", "k", "path", "at", "reach").join(known, "path")
        near = options.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - F.col("window")) / width), F.floor(F.col("at") / width))))
        met = near.join(rests, ["run", "_b"]).where((F.col("odo") <= F.col("at")) & (F.col("odo") >= F.col("at") - F.col("window")))
        options = options.join(met.select("run", "next").distinct().withColumn("_stood", F.lit(True)), ["run", "next"], "left")
        p = (F.col("stood") + 0.5) / (F.col("n") + 1)
        score = F.log(F.col("n") + 0.5) + F.log(F.when(F.col("_stood"), p).otherwise(1 - p))
        best = options.groupBy("run", "k", "at", "reach").agg(F.max_by(F.struct("next", "_length"), F.struct(F.round(score, 9), -F.col("next"))).alias("b"))
        front = best.select("run", (F.col("k") + 1).alias("k"), F.col("b.next").alias("path"), F.col("at").alias("base"), F.col("b._length").alias("length"), "reach")
        front = cut(front.join(exits, "path", "left").select(*parts[0].columns))
        parts.append(front)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("run", "k", "path", "base", "length", F.col("_goes").isNull().alias("ends"))


def advance(odometer: DataFrame, route: DataFrame, points: DataFrame, bucket: float | None = None, arc_bucket: float | None = None) -> DataFrame:
    """odometer (run, odo, ...) with path, s, hold, x, y, heading (from the y axis): where each row is.

    hold is the way made beyond a dead end; before the route's begin the place is that begin.  Rows without an odometer,
    or of runs without a route, have no place.
    """
    ways = route.select("run", F.col("base").alias("odo"), "path", "base", "length", "k")
    on = timejoin.asof(odometer, ways, "run", "odo", ["path", "base", "length"], "clamp", tie="k", bucket=bucket)
    way = F.col("odo") - F.col("other_base")
    on = on.withColumns({"path": F.col("other_path"), "s": F.when(way.isNotNull(), F.least(F.greatest(way, F.lit(0.0)), F.col("other_length"))), "hold": F.when(way.isNotNull(), F.greatest(way - F.col("other_length"), F.lit(0.0)))})
    on = on.drop(*[c for c in on.columns if c.startswith("other_")])
    # each point brings the heading of the stretch before it, which holds at a path's end
    w = Window.partitionBy("path").orderBy("s")
    known = points.withColumn("heading", F.atan2(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    at = timejoin.around(on, known, "path", "s", ["x", "y", "heading"], bucket=arc_bucket)
    dx, dy = F.col("next.x") - F.col("prev.x"), F.col("next.y") - F.col("prev.y")
    return at.withColumns({"x": timejoin.between(F.col("s"), "s", "x"), "y": timejoin.between(F.col("s"), "s", "y"), "heading": F.when(F.col("next").isNull(), F.col("prev.heading")).when(F.col("prev").isNotNull(), F.atan2(dx, dy))}).drop("prev", "next")


@dataclass(frozen=True)
class AnchorRules:
    sigma: float = 2.0  # along, just after an anchor
    growth: float = 0.003  # of sigma, per way since the last anchor
    most: float = 100.0  # a shift beyond this is not followed


@dataclass
class Shift:
    shift: float = 0.0
    since: float = 0.0


def anchoring(r: AnchorRules) -> Fold:
    """The fold over stands (odo, stops: array of at and sd on the run's route)."""

    def step(s: Shift, e: dict) -> list[tuple]:
        here = e["odo"] + s.shift
        fits = [
            (abs(x["at"] - here), x["at"]) for x in e["stops"] or []
            if abs(x["at"] - here) <= 3 * hypot(x["sd"], r.sigma + r.growth * abs(e["odo"] - s.since)) and abs(x["at"] - e["odo"]) <= r.most
        ]
        if not fits:
            return []
        moved = min(fits)[1] - here
        s.shift, s.since = s.shift + moved, e["odo"]
        return [(e["odo"], moved, s.shift)]

    return Fold(Shift, step, ["odo", "stops"], "odo double, moved double, shift double")


def anchors(stands: DataFrame, route: DataFrame, stops: DataFrame, r: AnchorRules) -> DataFrame:
    """run, odo, moved, shift: stands (run, us, odo) tied to stops (path, s, sd) on the run's route, in order of time.

    The nearest stop (the first of equal ones) within three sigma of the shifted place counts.  Only stops within
    `most` of a stand reach it: a stand is laid on the paths around it, by buckets of the stretch on which its run stands,
    and meets the stops of these by buckets of the arc length.  So a path's stops are not listed for every run.
    """
    own = cut(stands.where("run is not null and odo is not null").select("run", "us", "odo").distinct())
    span = own.groupBy("run").agg((F.min("odo") - 2 * r.most).alias("_lo"), (F.max("odo") + 2 * r.most).alias("_hi"))
    ways = route.join(span, "run").where("base <= _hi and base + length >= _lo")
    ways = ways.select("run", "k", "path", "base", "length", F.explode(F.sequence(F.floor(F.greatest("base", "_lo") / r.most), F.floor(F.least(F.col("base") + F.col("length"), "_hi") / r.most))).alias("_b"))
    around = own.withColumn("_b", F.explode(F.array(*(F.floor(F.col("odo") / r.most) + d for d in (-1, 0, 1)))))
    laid = around.join(ways, ["run", "_b"]).select("run", "us", "odo", "k", "path", "base", "length").distinct()
    # a hair more than the reach, which the distance itself decides
    edge = lambda way, hair: F.floor((F.col("odo") + way - F.col("base")) / r.most + hair)
    laid = laid.withColumn("_b", F.explode(F.sequence(edge(-r.most, -1e-6), edge(r.most, 1e-6))))
    at = stops.withColumn("_b", F.floor(F.col("s") / r.most))
    near = laid.join(at, ["path", "_b"]).where("s between 0 and length").withColumn("at", F.col("base") + F.col("s"))
    near = near.where(F.abs(F.col("at") - F.col("odo")) <= r.most)
    met = near.groupBy("run", "us", "odo").agg(F.array_sort(F.collect_list(F.struct("at", "sd"))).alias("stops"))
    return output(fold(met, ["run"], ["us", "odo"], anchoring(r))).drop("bucket")


def anchored(odometer: DataFrame, found: DataFrame, bucket: float | None = None) -> DataFrame:
    """odometer rows with odo shifted by the last anchor at or before them."""
    got = timejoin.asof(odometer, found.select("run", "odo", "shift"), "run", "odo", ["shift"], bucket=bucket)
    return got.withColumn("odo", F.col("odo") + F.coalesce("other_shift", F.lit(0.0))).drop("other_odo", "other_shift")
