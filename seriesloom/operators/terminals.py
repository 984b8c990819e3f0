"""Ends of lines: where tracks begin and end, passages through these places, and branches behind dead ends of a map.

A track is rows (run, us, seq, x, y).  A long run is never one task: its rows
are numbered by time buckets, and passages are entries and exits found by
joins on row numbers.  What is computed in windows is one passage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timejoin
from .clusters import linked_in_plane
from .lineage import cut
from .sets import first_fit
from .spatial import within


def numbered(track: DataFrame, bucket: int) -> DataFrame:
    """track with i, the row's number in its run by us and seq from 1, and n, the rows of the run.

    Rows are numbered within time buckets, and buckets by the sums of the counts before; rows without run or time go.
    """
    d = track.where("run is not null and us is not null").withColumn("_b", F.floor(F.col("us") / bucket))
    per = d.groupBy("run", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("run", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("run")).alias("n"))
    own = F.row_number().over(Window.partitionBy("run", "_b").orderBy("us", "seq"))
    return d.withColumn("_i", own).join(per, ["run", "_b"]).withColumn("i", F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def centres(rows: DataFrame, link: float, least: int) -> DataFrame:
    """centre, x, y, runs, n: single-link groups of the first and last places of numbered tracks, of at least so many runs.

    A run of one row gives its place twice.  Runs are integers; places that are null or not finite give no end.
    """
    ends = rows.where("i = 1 or i = n").select("run", "x", "y", F.explode(F.array_compact(F.array(F.when(F.col("i") == 1, 0), F.when(F.col("i") == F.col("n"), 1)))).alias("_e"))
    ends = cut(ends.withColumn("key", F.col("run") * 2 + F.col("_e")))
    groups = linked_in_plane(ends, "key", "x", "y", link).join(ends, "key").groupBy(F.col("cluster").alias("centre"))
    g = groups.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_distinct("run").alias("runs"), F.count("*").alias("n"))
    return g.where(F.col("runs") >= least)


def passages(rows: DataFrame, at: DataFrame, radius: float) -> DataFrame:
    """run, centre, first, last, ends: passages of numbered tracks through circles around centres (centre, x, y).

    A passage lasts from the row before its entry to the last row inside; one that was inside from its run's first row on
    is none.  ends: whether its last row is the run's.
    """
    probes = at.select("centre", F.col("x").alias("px"), F.col("y").alias("py"))
    inside = cut(within(probes, rows.select("run", "i", "n", "x", "y"), radius).where(F.col("d") < radius).select("run", "centre", "i", "n"))
    shifted = lambda by: inside.select("run", "centre", (F.col("i") + by).alias("i"))
    here = ["run", "centre", "i"]
    order = F.row_number().over(Window.partitionBy("run", "centre").orderBy("i"))
    entries = inside.join(shifted(1), here, "left_anti").select("run", "centre", (F.col("i") - 1).alias("first"), order.alias("_k"))
    exits = inside.join(shifted(-1), here, "left_anti").select("run", "centre", F.col("i").alias("last"), (F.col("i") == F.col("n")).alias("ends"), order.alias("_k"))
    return entries.join(exits, ["run", "centre", "_k"]).where("first > 0").drop("_k")


def arrivals(found: DataFrame, rows: DataFrame, link: float) -> DataFrame:
    """run, centre, first, last, main: passages on which a run ended, and whether it ended where most do.

    The last places of a centre's arrivals are grouped by single link; the largest group, of equal ones the one with the
    smallest run, is the platform.  The others went on along a branch, and are no evidence for the line.
    """
    last = rows.where("i = n").select("run", "x", "y")
    arrived = cut(found.where("ends").join(last, "run"))
    groups = cut(linked_in_plane(arrived, "run", "x", "y", link, by="centre"))
    main = groups.groupBy("centre", "cluster").agg(F.count("*").alias("_n")).groupBy("centre").agg(F.max_by("cluster", F.struct("_n", F.negative("cluster"))).alias("_main"))
    where = groups.join(main, "centre").select("run", "centre", (F.col("cluster") == F.col("_main")).alias("main"))
    return arrived.join(where, ["run", "centre"]).select("run", "centre", "first", "last", "main")


# ---- branches


@dataclass(frozen=True)
class BranchRules:
    more: float = 25.0  # way made behind the dead end, at least
    away: float = 15.0  # and the end is farther from it than this
    apart: float = 4.0  # a passage farther from its cursor than this (median of eleven) has left it
    hold_join: float = 6.0  # dead ends nearer than this are one
    axis_join: float = 5.0  # nine tenths of an axis nearer than this to another are one branch
    past: float = 15.0  # axes are compared from so far behind the dead end on
    step: float = 1.0  # of an axis
    margin: float = 10.0  # the window before a dead end is the longest of its branches and this,
    window: float = 60.0  # and at least this


HALF = 5  # rows on each side of the median of eleven


def departures(points: DataFrame, r: BranchRules) -> DataFrame:
    """passage, s_from, s_hold, x, y: passages that left their cursor, where on their way, and its dead end.

    points: passage, i, s (way), x, y, cx, cy (the cursor's place), held (it stands at a dead end).  A passage departs at
    the row after the last one near its cursor, at most at the row where that is first held.
    """
    held = points.where("held").groupBy("passage").agg(F.min("i").alias("_h"), F.min_by(F.struct("s", "cx", "cy"), "i").alias("_hold"))
    end = points.groupBy("passage").agg(F.max_by(F.struct("s", "x", "y"), "i").alias("_end"))
    dx, dy = F.col("_end.x") - F.col("_hold.cx"), F.col("_end.y") - F.col("_hold.cy")
    went = held.join(end, "passage").where((F.col("_end.s") - F.col("_hold.s") >= r.more) & (F.sqrt(dx * dx + dy * dy) >= r.away))
    went = cut(went.select("passage", "_h", "_hold"))
    ox, oy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    up = points.join(went, "passage").where(F.col("i") <= F.col("_h")).select("passage", "i", "s", F.sqrt(ox * ox + oy * oy).alias("d"))
    whole, order = Window.partitionBy("passage"), Window.partitionBy("passage").orderBy("i")
    up = up.withColumns({"j": F.row_number().over(order), "m": F.count("*").over(whole), "_near": F.collect_list("d").over(order.rowsBetween(-HALF, HALF))})
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = up.withColumns({"_a": F.first("d").over(full), "_z": F.last("d").over(full)})
    # the first and last values stand for the rows beyond
    pad = lambda value, n: F.array_repeat(value, F.greatest(F.lit(0), n).cast("int"))
    row = F.concat(pad("_a", HALF + 1 - F.col("j")), "_near", pad("_z", HALF - F.col("m") + F.col("j")))
    up = up.select("passage", "j", "m", "s", F.when(F.col("m") < 2 * HALF + 1, F.col("d")).otherwise(F.element_at(F.array_sort(row), HALF + 1)).alias("d"))
    up = cut(up)
    since = up.groupBy("passage").agg(F.least(F.coalesce(F.max(F.when(F.col("d") <= r.apart, F.col("j"))), F.lit(0)) + 1, F.max("m")).alias("j"))
    began = up.join(since, ["passage", "j"]).select("passage", F.col("s").alias("s_from"))
    return began.join(went, "passage").select("passage", "s_from", F.col("_hold.s").alias("s_hold"), F.col("_hold.cx").alias("x"), F.col("_hold.cy").alias("y"))


def axes(points: DataFrame, left: DataFrame, r: BranchRules) -> tuple[DataFrame, DataFrame]:
    """passage, s, x, y: the axis of each departed passage by its way since; and passage, noise: how far its rows lie off it (nine tenths of them).

    Rows of one step are averaged, then five steps with the outer ones repeated at both ends.
    """
    own = cut(points.join(left, "passage").where(F.col("s") >= F.col("s_from")).select("passage", "i", (F.col("s") - F.col("s_from")).alias("s"), points["x"], points["y"]))
    per = own.groupBy("passage", F.floor(F.col("s") / r.step).alias("q")).agg(*(F.avg(c).alias(c) for c in ("s", "x", "y")))
    order, whole = Window.partitionBy("passage").orderBy("q"), Window.partitionBy("passage")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j, m = F.row_number().over(order), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), 3 - j), F.greatest(F.lit(0), 2 - m + j)
    smooth = lambda c: F.when(m < 5, F.col(c)).otherwise((F.sum(c).over(order.rowsBetween(-2, 2)) + before * F.first(c).over(full) + after * F.last(c).over(full)) / 5)
    axis = cut(per.select("passage", "s", smooth("x").alias("x"), smooth("y").alias("y")))
    at = timejoin.around(own, axis, "passage", "s", ["x", "y"])
    dx, dy = (F.col(c) - timejoin.between(F.col("s"), "s", c) for c in ("x", "y"))
    noise = at.groupBy("passage").agg(F.round(F.percentile(F.sqrt(dx * dx + dy * dy), F.lit(0.9)), 9).alias("noise"))
    return axis, noise


#: Passages of a dead end that a round tries as openers: in the first round, and at most; each round has twice as many.
TRIED = 256, 512


def _along(parts: DataFrame, sizes: DataFrame, axis: DataFrame, openers: DataFrame, radius: float) -> DataFrame:
    """passage, branch, _at: which of the parts' passages run along which axes of openers (passage, dead_end, _at) of the same dead end."""
    ways = axis.join(openers.select("passage", F.col("dead_end").alias("_end"), "_at"), "passage")
    ways = ways.select(F.col("passage").alias("branch"), "_end", "_at", F.col("x").alias("px"), F.col("y").alias("py"))
    near = within(ways, parts, radius).where(F.col("dead_end") == F.col("_end"))
    return near.groupBy("passage", "branch", "_at").agg(F.count_distinct("s").alias("_near")).join(sizes, "passage").where("10 * _near >= 9 * _size").select("passage", "branch", "_at")


def _opening(some: DataFrame, along: DataFrame) -> DataFrame:
    """passage, dead_end, _at of those of some that run along no earlier one of them that opens."""
    kind = f"array<{dict(some.dtypes)['passage']}>"
    takers = along.groupBy("passage").agg(F.collect_set("branch").alias("_by"))
    rows = some.join(takers, "passage", "left").select("dead_end", F.struct("_at", "passage", F.coalesce("_by", F.array().cast(kind)).alias("_by")).alias("_p"))
    add = lambda opened, p: F.when(F.arrays_overlap(opened, p["_by"]), opened).otherwise(F.concat(opened, F.array(p["passage"])))
    opened = rows.groupBy("dead_end").agg(F.aggregate(F.array_sort(F.collect_list("_p")), F.array().cast(kind), add).alias("_o"))
    return some.join(opened.select(F.explode("_o").alias("passage")), "passage", "left_semi")


def branches(points: DataFrame, stands: DataFrame, r: BranchRules = BranchRules()) -> tuple[DataFrame, DataFrame]:
    """dead_end, branch, x, y, off, window, n, stood, and the axes (branch, s, x, y): branches behind dead ends that a map lacks.

    points as in `departures`; stands: passage, s.  Dead ends are opened in order of passages, each takes those within
    hold_join.  Of a dead end's passages the one least off its axis opens a branch, takes all that run along it, and so
    on with the rest.  A round does so for the next few hundred of every dead end at once: they are laid on one another's
    axes, those that no earlier opener takes open, and all others meet only what has opened.  off: the way from the
    branch's begin to the dead end; stood: passages of the branch with a stand in the window before the dead end or up to
    `past` behind.

    Passages are integers; rows with a null in any column take no part; a passage named by its number is also its branch.
    """
    known = ["passage", "i", "s", "x", "y", "cx", "cy", "held"]
    points = cut(points.select(*known).dropna())
    left = cut(departures(points, r))
    axis, noise = axes(points, left, r)
    ends = first_fit(left.withColumn("_one", F.lit(0)), "_one", "passage", "x", "y", r.hold_join).select("passage", F.col("cluster").alias("dead_end"))
    all_ = cut(left.join(ends, "passage").join(noise, "passage").withColumn("off", F.col("s_hold") - F.col("s_from")))
    parts = axis.join(all_.select("passage", "off", "dead_end"), "passage").where(F.col("s") >= F.col("off") + r.past)
    parts = cut(parts.select("passage", "dead_end", "s", "x", "y"))
    sizes = cut(parts.groupBy("passage").agg(F.count("*").alias("_size")))
    # of equal ways the first opens a branch, or is taken, for all; one with no part behind the end is taken by none
    way = axis.groupBy("passage").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("s", "x", "y")))), 256).alias("_way"))
    seen = cut(all_.join(way, "passage").join(sizes.select("passage"), "passage").select("passage", "dead_end", "noise", "off", "_way"))
    alike = ["dead_end", "noise", "off", "_way"]
    equal = cut(seen.join(seen.groupBy(*alike).agg(F.min("passage").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), alike).where("passage <> _first").select("passage", "_first"))
    open_, parts, ways = (d.join(equal, "passage", "left_anti") for d in (all_.select("passage", "dead_end", "noise"), parts, axis))
    open_, parts, ways, done, tried = cut(open_), cut(parts), cut(ways), [], TRIED[0]
    while not open_.isEmpty():
        order = F.row_number().over(Window.partitionBy("dead_end").orderBy("noise", "passage"))
        some = cut(open_.withColumn("_at", order).where(F.col("_at") <= tried).select("passage", "dead_end", "_at"))
        first = cut(_opening(some, _along(parts.join(some.select("passage"), "passage", "left_semi"), sizes, ways, some, r.axis_join)))
        along = _along(parts, sizes, ways, first, r.axis_join)
        own = along.groupBy("passage").agg(F.min_by("branch", "_at").alias("branch"))
        took = cut(own.unionByName(first.select("passage", F.col("passage").alias("branch"))).distinct())
        done.append(took)
        open_, parts, ways = (cut(d.join(took, "passage", "left_anti")) for d in (open_, parts, ways))
        tried = min(2 * tried, TRIED[1])
    of = all_.select("passage", F.col("passage").alias("branch")).limit(0)
    for part in done:
        of = of.unionByName(part)
    of = of.unionByName(equal.join(of.withColumnRenamed("passage", "_first"), "_first").select("passage", "branch"))
    own = of.join(all_, "passage")
    heads = own.where("passage = branch").select("branch", "dead_end", "off")
    wide = heads.groupBy("dead_end").agg(F.greatest(F.max("off") + r.margin, F.lit(r.window)).alias("window"))
    place = all_.where("passage = dead_end").select("dead_end", "x", "y")
    own = own.select("passage", "branch", "dead_end", "s_hold").join(wide, "dead_end")
    rests = stands.select("passage", F.col("s").alias("_at"))
    stood = own.join(rests, "passage").where((F.col("_at") >= F.col("s_hold") - F.col("window")) & (F.col("_at") <= F.col("s_hold") + r.past)).select("passage").distinct()
    counts = own.join(stood.withColumn("_stood", F.lit(1)), "passage", "left").groupBy("branch", "window").agg(F.count("*").alias("n"), F.count("_stood").alias("stood"))
    out = heads.join(counts, "branch").join(place, "dead_end").select("dead_end", "branch", "x", "y", "off", "window", "n", "stood")
    return out, axis.join(heads.select(F.col("branch").alias("passage")), "passage", "left_semi").withColumnRenamed("passage", "branch")
