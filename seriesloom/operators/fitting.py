"""Lag search, normal equations, robust regression, scales and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .lineage import cut
from .timejoin import asof


def lag_search(ref: DataFrame, other: DataFrame, by: str, on: str, value: str, lags: list[int], least: int) -> DataFrame:
    """by, lag, rms: the lag under which other, shifted, is nearest to ref.  Lags are a parameter of fixed length."""
    each = F.explode(F.array(*map(F.lit, lags))).alias("lag")
    key = F.concat_ws(":", F.col(by).cast("string"), F.col("lag").cast("string"))
    a = ref.select(by, on, F.col(value).alias("ref"), each).withColumn("_key", key)
    b = other.select(by, on, value, each).withColumn(on, F.col(on) + F.col("lag")).select(key.alias("_key"), on, value)
    d = asof(a, b, "_key", on, [value]).withColumn("e", F.col("ref") - F.col(f"other_{value}"))
    g = d.groupBy(by, "lag").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.count("e").alias("n")).where(F.col("n") >= least)
    return g.groupBy(by).agg(F.min(F.struct(F.round("rms", 6).alias("rms"), "lag")).alias("m")).select(by, "m.lag", "m.rms")


def hats(x: Column, low: float, step: float, n: int) -> list[tuple[Column, Column]]:
    """The two grid nodes around x, clamped, and their linear weights."""
    p = F.least(F.greatest((x - low) / step, F.lit(0.0)), F.lit(float(n - 1)))
    i = F.least(F.floor(p), F.lit(n - 2))
    return [(i, 1 - (p - i)), (i + 1, p - i)]


def normal_equations(df: DataFrame, u: Column, v: Column, y: Column, grid_u: tuple, grid_v: tuple) -> DataFrame:
    """i, j, ata: sums of weight products of a bilinear design; j = -1 holds the right-hand side.

    Corners are exploded and paired in the row, so one aggregate of grid size remains.
    """
    corners = F.array(*(F.struct((a * grid_v[2] + b).cast("long").alias("k"), (wa * wb).alias("w")) for a, wa in hats(u, *grid_u) for b, wb in hats(v, *grid_v)))
    d = df.select(corners.alias("c"), y.cast("double").alias("y"))
    one = d.select(F.explode("c").alias("p"), "c", "y")
    right = one.select(F.col("p.k").alias("i"), F.lit(-1).cast("long").alias("j"), (F.col("p.w") * F.col("y")).alias("x"))
    both = one.select("p", F.explode("c").alias("q")).select(F.col("p.k").alias("i"), F.col("q.k").alias("j"), (F.col("p.w") * F.col("q.w")).alias("x"))
    return both.unionByName(right).groupBy("i", "j").agg(F.sum("x").alias("ata"))


def robust_regression(df: DataFrame, by: str, x: str, y: str, rounds: int = 3) -> DataFrame:
    """by, slope, intercept, n: least squares, refitted to rows whose residual is within 4 scaled median deviations.

    Medians come from range counts, so that no task holds a group.  What a round leaves is one small row a key; the rows
    themselves are read anew.  A key of whose rows none is left has no line, and n is 0.
    """
    d = df.where(F.col(by).isNotNull()).select(by, x, y)
    e = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    kept = lambda c: F.when(F.col("_keep"), F.col(c))
    fit = lambda rows: rows.groupBy(by).agg(F.regr_slope(kept(y), kept(x)).alias("slope"), F.regr_intercept(kept(y), kept(x)).alias("intercept"), F.count(kept(y)).alias("n"))
    few = lambda t: F.broadcast(t) if t.count() <= quantiles.BROADCAST else t
    median = lambda rows, name: quantiles.order_statistics(rows, [by], name, [0.5]).select(by, F.col("x").alias(f"{name}_mid"))
    judged = d.withColumn("_keep", F.lit(True))
    last = cut(fit(judged))
    for _ in range(rounds):
        now = judged.where("_keep").select(by, x, y).join(few(last), by).withColumn("_e", e).select(by, "_e")
        middle = cut(median(now, "_e"))
        away = median(now.join(few(middle), by).select(by, F.abs(F.col("_e") - F.col("_e_mid")).alias("_d")), "_d")
        known = cut(last.drop("n").join(middle, by, "left").join(away, by, "left"))
        judged = d.join(few(known), by).withColumn("_keep", F.coalesce(F.abs(e - F.col("_e_mid")) < 4 * 1.4826 * F.col("_d_mid"), F.lit(False))).select(by, x, y, "_keep")
        last = cut(fit(judged))
    return last


def sharpest(df: DataFrame, grid: list[tuple[float, float]], e: Column, scale: Column, bound: float) -> DataFrame:
    """a, b, cover, width: of sigma = sqrt(a^2 + (b scale)^2), the narrowest that covers the bound at two sigma, or the one that covers most."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in grid))).alias("g")
    sigma = F.sqrt(F.col("g.a") ** 2 + (F.col("g.b") * F.col("scale")) ** 2)
    d = df.select(e.alias("e"), scale.alias("scale"), each).withColumn("sigma", sigma)
    g = d.groupBy("g.a", "g.b").agg(F.avg((F.abs("e") <= 2 * F.col("sigma")).cast("int")).alias("cover"), F.avg("sigma").alias("width"))
    rank = F.struct(F.when(g["cover"] >= bound, 0).otherwise(1), F.when(g["cover"] >= bound, F.round("width", 9)).otherwise(-F.round("cover", 9)), "a", "b")
    return g.agg(F.min_by(F.struct("a", "b", F.round("cover", 6).alias("cover"), F.round("width", 6).alias("width")), rank).alias("m")).select("m.*")


def within_percent_of_best(df: DataFrame, score: str, prefer: str, percent: float) -> DataFrame:
    """The row with the least `prefer` among those whose score is within percent of the best."""
    best = df.agg(F.min(score)).first()[0]  # one number
    return df.where(F.col(score) <= F.lit(best) * (1 + percent / 100)).orderBy(prefer, score).limit(1)
