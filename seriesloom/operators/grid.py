"""Grids on integer time, resampling, integration, differences, clock correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timejoin import around, asof, between


def nodes(df: DataFrame, by: str, on: str, step: int) -> DataFrame:
    """Grid nodes at whole multiples of step, from the first row of a key to its last."""
    ends = df.groupBy(by).agg(F.floor(F.min(on) / step).alias("a"), F.floor(F.max(on) / step).alias("b"))
    return ends.select(by, F.explode(F.sequence("a", "b")).alias("node")).withColumn(on, F.col("node") * step)


def locf(df: DataFrame, by: str, on: str, value: str, step: int, tie: str) -> DataFrame:
    """by, node, on, value: the last value at or before each node."""
    return asof(nodes(df, by, on, step), df, by, on, [value], tie=tie).select(by, "node", on, F.col(f"other_{value}").alias(value))


def interpolated(df: DataFrame, by: str, on: str, value: str, step: int, tie: str) -> DataFrame:
    got = around(nodes(df, by, on, step), df, by, on, [value], tie)
    return got.select(by, "node", on, between(F.col(on), on, value).alias(value))


def steps(df: DataFrame, by: list[str], on: str, value: str, order: list, cap: float | None = None) -> DataFrame:
    """df with dt (seconds to the row before, at most cap) and area (trapezoid of value)."""
    w = Window.partitionBy(*by).orderBy(*order)
    dt = (F.col(on) - F.lag(on).over(w)) / 1e6
    df = df.withColumn("dt", F.least(F.greatest(dt, F.lit(0.0)), F.lit(float(cap))) if cap else dt)
    return df.withColumn("area", 0.5 * (F.col(value) + F.lag(value).over(w)) * F.col("dt"))


def cumulative(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def centred_difference(df: DataFrame, by: list[str], on: str, value: str, k: int = 1) -> DataFrame:
    """df with slope: the change of value over the change of time between the rows k before and k after."""
    w = Window.partitionBy(*by).orderBy(on)
    span = (F.lead(on, k).over(w) - F.lag(on, k).over(w)) / 1e6
    return df.withColumn("slope", (F.lead(value, k).over(w) - F.lag(value, k).over(w)) / span)


def gradient(df: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """df with slope (per second): second order on uneven steps inside, one-sided at both ends."""
    w = Window.partitionBy(*by).orderBy(on)
    hs, hd = (F.col(on) - F.lag(on).over(w)) / 1e6, (F.lead(on).over(w) - F.col(on)) / 1e6
    before, v, after = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    inner = (hs * hs * after + (hd * hd - hs * hs) * v - hd * hd * before) / (hs * hd * (hs + hd))
    return df.withColumn("slope", F.when(hs.isNull(), (after - v) / hd).when(hd.isNull(), (v - before) / hs).otherwise(inner))


def corrected_clock(df: DataFrame, by: list[str], arrived: str, stamped: str, most: int) -> DataFrame:
    """df with fixed: the stamp, or arrival less the median offset where a stamp is further off than most."""
    off = F.col(arrived) - F.col(stamped)
    middle = F.percentile(off, F.lit(0.5)).over(Window.partitionBy(*by))
    return df.withColumn("fixed", F.when(F.abs(off - middle) > most, F.round(F.col(arrived) - middle).cast("long")).otherwise(F.col(stamped)))


def by_path(df: DataFrame, by: str, path: str, value: str, step: float) -> DataFrame:
    """by, bin, value: the mean in each bin of path length."""
    return df.groupBy(by, F.floor(F.col(path) / step).alias("bin")).agg(F.avg(value).alias(value))


def delta_encoded(df: DataFrame, by: list[str], order: list, value: str, scale: float) -> DataFrame:
    """df with quant (value times scale, whole; null stays) and delta to the last quant that is not null."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("quant", F.round(F.col(value) * scale).cast("long"))
    return df.withColumn("delta", F.col("quant") - F.coalesce(F.last("quant", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
