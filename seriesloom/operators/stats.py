"""Aggregates: error figures, distributions, coverage, weighted totals, bins, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


def error_stats(e: Column) -> list[Column]:
    """n, rmse, mae, bias, p95, worst and median of |e|; null if there is nothing."""
    a = F.abs(e)
    return [
        F.count(e).alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(a), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"),
        F.round(F.percentile(a, F.lit(0.95)), 6).alias("p95"), F.round(F.max(a), 6).alias("worst"), F.round(F.percentile(a, F.lit(0.5)), 6).alias("median"),
    ]


def error_stats_of_few(df: DataFrame, by: list[str], e: str, *more: Column) -> DataFrame:
    """by, the figures of error_stats, and more aggregates, for few large groups: percentiles by range counts, so that no task holds a group."""
    plain = [c for k, c in enumerate(error_stats(F.col(e))) if k not in (4, 6)]
    q = quantiles.order_statistics(df.withColumn("_a", F.abs(e)), by, "_a", [0.5, 0.95])
    q = quantiles.side_by_side(q, by, {0.5: "median", 0.95: "p95"})
    order = ["n", "rmse", "mae", "bias", "p95", "worst", "median"]
    d = df.groupBy(*by).agg(*plain, *more)
    rest = [c for c in d.columns if c not in order and c not in by]
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    d = d.join(q.withColumnsRenamed({c: f"_{c}" for c in by}), same, "left")
    return d.select(*by, *(F.round(c, 6).alias(c) if c in ("p95", "median") else c for c in order), *rest)


def distribution(x: Column) -> list[Column]:
    p = lambda q, name: F.round(F.percentile(x, F.lit(q)), 6).alias(name)
    return [F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.round(F.max(x), 6).alias("max")]


def correlation(x: Column, y: Column) -> Column:
    """Of pairs without nulls; NaN where one of the two does not vary (corr is an error there), null without pairs."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def coverage(e: Column, sigma: Column, k: float) -> Column:
    return F.avg((F.abs(e) <= k * sigma).cast("int"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Rows where x is null give no weight."""
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def weighted_rms(x: Column, w: Column) -> Column:
    return F.sqrt(weighted_mean(x * x, w))


def phase(speed: Column, notch: Column) -> Column:
    """standstill first, then by the sign of the notch; a missing notch is 0."""
    u = F.coalesce(notch, F.lit(0.0))
    return F.when(speed < 0.2, "standstill").when(u > 0, "traction").when(u < 0, "brake").otherwise("coast")


def merged_histogram(df: DataFrame, packed: str) -> DataFrame:
    """key, total of strings 'k:v;k:v'."""
    return df.select(F.explode(F.str_to_map(packed, F.lit(";"), F.lit(":"))).alias("key", "v")).groupBy("key").agg(F.sum(F.col("v").cast("long")).alias("total"))


def binned_median(df: DataFrame, x: Column, y: Column, value: str, least: int) -> DataFrame:
    """xbin, ybin, n, median (null for fewer than least rows)."""
    g = df.groupBy(x.alias("xbin"), y.alias("ybin")).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("m"))
    return g.select("xbin", "ybin", "n", F.when(F.col("n") >= least, F.round("m", 6)).alias("median"))


def within_bins(df: DataFrame, by: list[str], bin_: Column, value: str) -> DataFrame:
    """Residual variance within bins over all rows."""
    g = df.groupBy(*by, bin_.alias("_bin")).agg(F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.groupBy(*by).agg((F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")).alias("residual"))


def trend(y: Column, x: Column) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]
