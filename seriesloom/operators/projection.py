"""Projection of points on travelled tracks and on path graphs.

Segments of any length are listed in the cells they cross and points look two
cells around, so a join on cells finds every segment within reach; what no
segment is near of is looked for again with twice the reach.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import running, timejoin
from .folds import Fold, fold, output
from .lineage import cut
from .spatial import around_cells, cell


def near_segments(probes: DataFrame, segments: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """probes (by, px, py, ...) with the segments (by, ax, ay, ex, ey, ...) within reach, t_raw (length along, unclipped), along, dist and side (positive to the left)."""
    dx, dy = F.col("ex") - F.col("ax"), F.col("ey") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    n = F.greatest(F.ceil(length / reach), F.lit(1))
    middle = lambda i: (i + F.lit(0.5)) / n
    cells = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(cell(F.col("ax") + middle(i) * dx, reach).alias("cx"), cell(F.col("ay") + middle(i) * dy, reach).alias("cy"))))
    finite = (length > 0) & (length < float("inf"))  # NaN is not
    listed = segments.where(finite).withColumn("_cell", F.explode(cells)).select("*", "_cell.cx", "_cell.cy").drop("_cell")
    met = around_cells(probes, "px", "py", reach, 2).join(listed, [*by, "cx", "cy"]).drop("cx", "cy").distinct()
    # divided last, so that a point on the line of a segment has the side 0 where the numbers allow it
    raw = ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / F.col("length")
    met = met.withColumn("length", length).withColumn("t_raw", raw).withColumn("along", F.least(F.greatest("t_raw", F.lit(0.0)), F.col("length")))
    gx, gy = F.col("px") - F.col("ax") - F.col("along") * dx / F.col("length"), F.col("py") - F.col("ay") - F.col("along") * dy / F.col("length")
    gap = F.sqrt(gx * gx + gy * gy)
    side = (dx * (F.col("py") - F.col("ay")) - dy * (F.col("px") - F.col("ax"))) / F.col("length")
    return met.withColumns({"dist": gap, "side": side}).where(F.col("dist") <= reach)


@dataclass
class Last:
    x: float | None = None
    y: float | None = None


def thinning(least: float) -> Fold:
    """Keeps a point if it lies at least so far from the last one kept."""

    def step(s: Last, p: dict) -> list[tuple]:
        if p["x"] is None or p["y"] is None or (s.x is not None and hypot(p["x"] - s.x, p["y"] - s.y) < least):
            return []
        s.x, s.y = p["x"], p["y"]
        return [(p["us"], p["x"], p["y"])]

    return Fold(Last, step, ["us", "x", "y"], "us long, x double, y double")


def track(ref: DataFrame, least: float, beyond: float) -> DataFrame:
    """run, seg, us, ax, ay, ex, ey, s: the segments of tracks (run, us, x, y), thinned, and one more before and behind.

    us is the time of a segment's first point (null before the track), s its arc length from the track's first point.
    A run of fewer than two points has none.  With least 0 two places may be one: their segment has no length, and what
    would prolong it no place (NaN).
    """
    kept = output(fold(ref, ["run"], ["us"], thinning(least)))
    w = Window.partitionBy("run").orderBy("us")
    at = kept.withColumns({"seg": F.row_number().over(w), "ex": F.lead("x").over(w), "ey": F.lead("y").over(w), "bx": F.lag("x").over(w), "by_": F.lag("y").over(w)})
    sx, sy = F.col("x") - F.col("bx"), F.col("y") - F.col("by_")
    step = F.sqrt(sx * sx + sy * sy)
    at = at.withColumn("s", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).where("ex is not null or bx is not null")
    own = at.where("ex is not null").select("run", "seg", "us", F.col("x").alias("ax"), F.col("y").alias("ay"), "ex", "ey", "s")
    far = lambda fx, fy, tx, ty: [running.quotient(beyond * d, F.hypot(tx - fx, ty - fy)) for d in (tx - fx, ty - fy)]
    x, y, ex, ey, bx, by_ = (F.col(c) for c in ("x", "y", "ex", "ey", "bx", "by_"))
    hx, hy = far(x, y, ex, ey)
    head = at.where("bx is null").select("run", F.lit(0).alias("seg"), F.lit(None).cast("long").alias("us"), (x - hx).alias("ax"), (y - hy).alias("ay"), x.alias("ex"), y.alias("ey"), F.lit(-beyond).alias("s"))
    tx, ty = far(bx, by_, x, y)
    tail = at.where("ex is null").select("run", "seg", "us", x.alias("ax"), y.alias("ay"), (x + tx).alias("ex"), (y + ty).alias("ey"), "s")
    return own.unionByName(head).unionByName(tail)


def along_cross(ref: DataFrame, est: DataFrame, least: float = 1.0, window: float = 1000.0, reach: float = 60.0, near: float = 5.0, bucket: int | None = None) -> DataFrame:
    """run, us, along, cross, s_ref: how far estimates (run, us, x, y) lie ahead of and to the left of a reference (run, us, x, y) of the same times.

    The reference is smoothed by medians of five, thinned, and prolonged at both
    ends.  An estimate is projected on the segments within `window` of its own
    reference place that lead the same way; of feet that are nearest among their
    neighbours and at most `near` farther than the nearest of all, the one
    nearest along the track counts.  Farther off than reach: null.
    """
    smooth = ref
    for c in ("x", "y"):
        smooth = running.rolling_median(smooth, ["run"], "us", c, 2, f"_{c}")
    smooth = cut(smooth.select("run", "us", F.col("_x").alias("x"), F.col("_y").alias("y")))
    segs = cut(track(smooth, least, window))
    own = timejoin.asof(smooth.where("x is not null and y is not null"), segs.where("us is not null"), "run", "us", ["ax", "ay", "ex", "ey", "s"], bucket=bucket).where("other_s is not null")
    ux, uy = F.col("other_ex") - F.col("other_ax"), F.col("other_ey") - F.col("other_ay")
    length = F.sqrt(ux * ux + uy * uy)
    leads = (length > 0) & (length < float("inf"))
    foot = ((F.col("x") - F.col("other_ax")) * ux + (F.col("y") - F.col("other_ay")) * uy) / F.when(leads, length)
    # where the reference stands it leads no way (NaN), and every way is its way: NaN is greater than 0
    ox, oy = (F.when(leads, u / F.when(leads, length)).otherwise(float("nan")) for u in (ux, uy))
    s_ref = F.col("other_s") + F.when(leads, F.least(F.greatest(foot, F.lit(0.0)), length)).otherwise(0.0)
    own = own.select("run", "us", s_ref.alias("s_ref"), ox.alias("ox"), oy.alias("oy"))
    probes = est.select("run", "us", F.col("x").alias("px"), F.col("y").alias("py")).join(own, ["run", "us"])
    met = near_segments(probes, segs.drop("us"), reach + near, ["run"])
    met = met.where(((F.col("ex") - F.col("ax")) * F.col("ox") + (F.col("ey") - F.col("ay")) * F.col("oy") > 0) & (F.col("s") + F.col("length") >= F.col("s_ref") - window) & (F.col("s") <= F.col("s_ref") + window))
    w = Window.partitionBy("run", "us").orderBy("seg")
    beside = lambda f, d: F.when(f("seg").over(w) == F.col("seg") + d, f("dist").over(w))
    met = met.withColumns({"_l": beside(F.lag, -1), "_r": beside(F.lead, 1), "_least": F.min("dist").over(Window.partitionBy("run", "us"))})
    local = (F.col("_l").isNull() | (F.col("dist") <= F.col("_l"))) & (F.col("_r").isNull() | (F.col("dist") <= F.col("_r")))
    met = met.where((F.col("_least") <= reach) & local & (F.col("dist") <= F.col("_least") + near)).withColumn("ahead", F.col("s") + F.col("along") - F.col("s_ref"))
    left = F.when(F.col("side") < 0, -F.col("dist")).otherwise(F.col("dist"))
    best = met.groupBy("run", "us").agg(F.min_by(F.struct("ahead", left.alias("left")), F.struct(F.abs("ahead"), "seg")).alias("b"))
    return est.select("run", "us").join(own.select("run", "us", "s_ref"), ["run", "us"], "left").join(best, ["run", "us"], "left").select("run", "us", F.col("b.ahead").alias("along"), F.col("b.left").alias("cross"), "s_ref")


def graph_segments(points: DataFrame) -> DataFrame:
    """path, seg, ax, ay, az, ex, ey, ez, s, first, last of points (path, pos, x, y, z)."""
    w = Window.partitionBy("path").orderBy("pos")
    at = points.withColumns({**{f"e{c}": F.lead(c).over(w) for c in "xyz"}, "seg": F.row_number().over(w)}).withColumnsRenamed({c: f"a{c}" for c in "xyz"})
    step = F.hypot(F.col("ex") - F.col("ax"), F.col("ey") - F.col("ay"))
    at = at.withColumn("s", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where("ex is not null")
    return at.withColumns({"first": F.col("seg") == 1, "last": F.col("seg") == F.max("seg").over(Window.partitionBy("path"))}).drop("pos")


def match_graph(probes: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """k, path, s, lat, dist, z, beyond: for each probe (k, px, py, yaw from the x axis; null: any) the nearest path that leads its way.

    Of each path the nearest segment counts; a path whose nearest segment leads
    against the yaw is none.  lat is positive to the left; beyond says that the
    probe lies more than half a unit behind an end of the path.  Probes without
    a path within reach are looked for with twice the reach, up to the extent
    of both tables; those that no path suits come without one.
    """
    segs = cut(graph_segments(points.where("path is not null and x is not null and y is not null")))
    # equal probes are one place, which is looked for once
    places = cut(cut(probes.select("px", "py", "yaw").where("px is not null and py is not null").distinct()).withColumn("k", F.monotonically_increasing_id()))
    left = places
    box = left.agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("px", "py"))).first()
    map_ = segs.agg(F.min(F.least("ax", "ex")), F.max(F.greatest("ax", "ex")), F.min(F.least("ay", "ey")), F.max(F.greatest("ay", "ey"))).first()
    found, r = [], reach
    extent = -1.0 if box[0] is None or map_[0] is None else hypot(max(box[2], map_[1]) - min(box[0], map_[0]), max(box[3], map_[3]) - min(box[1], map_[2]))
    while extent >= 0:
        met = near_segments(left, segs, r, [])
        one = met.groupBy("k", "path").agg(F.min_by(F.struct("*"), F.struct(F.round("dist", 9), "seg")).alias("b")).select("b.*")
        suits = F.col("yaw").isNull() | F.isnan("yaw") | (F.cos(F.atan2(F.col("ey") - F.col("ay"), F.col("ex") - F.col("ax")) - F.col("yaw")) > 0)
        best = one.where(suits).groupBy("k").agg(F.min_by(F.struct("*"), F.struct(F.round("dist", 9), "path")).alias("b")).select("b.*")
        beyond = (F.col("first") & (F.col("t_raw") < -0.5)) | (F.col("last") & (F.col("t_raw") > F.col("length") + 0.5))
        z = F.col("az") + (F.col("ez") - F.col("az")) * F.col("along") / F.col("length")
        best = cut(best.select("k", "path", (F.col("s") + F.col("along")).alias("s"), F.col("side").alias("lat"), "dist", z.alias("z"), beyond.alias("beyond")))
        found.append(best)
        left = cut(left.join(best.select("k"), "k", "left_anti"))
        if r > extent or left.isEmpty():
            break
        r *= 2
    kinds = "path {}, s double, lat double, dist double, z double, beyond boolean".format(dict(points.dtypes)["path"])
    out = found[0] if found else places.select("k").limit(0).select("k", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in kinds.split(", "))))
    for x in found[1:]:
        out = out.unionByName(x)
    at = places.join(out, "k").drop("k").withColumnsRenamed({c: f"_{c}" for c in ("px", "py", "yaw")})
    same = (F.col("px") == F.col("_px")) & (F.col("py") == F.col("_py")) & F.col("yaw").eqNullSafe(F.col("_yaw"))
    return probes.select("k", "px", "py", "yaw").join(at, same, "left").drop("px", "py", "yaw", "_px", "_py", "_yaw")

