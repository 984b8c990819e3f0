"""Row windows: lateness, lags, rolling medians and means, window search, prefix estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lateness(df: DataFrame, by: list[str], arrival: str, stamped: str) -> DataFrame:
    """df with peak (greatest stamp so far in arrival order) and late (how far behind it a row is)."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(stamped).over(w)).withColumn("late", F.col("peak") - F.col(stamped))


def lags(df: DataFrame, by: list[str], order: str, on: str) -> DataFrame:
    return df.withColumn("dt", F.col(on) - F.lag(on).over(Window.partitionBy(*by).orderBy(order)))


def rolling_median(df: DataFrame, by: list[str], order: str, value: str, half: int, name: str) -> DataFrame:
    """Centred median of 2 * half + 1 rows; rows nearer to an end keep their value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(w) == 2 * half + 1
    return df.withColumn(name, F.when(full, F.percentile(value, F.lit(0.5)).over(w)).otherwise(F.col(value)))


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def ahead_count(df: DataFrame, by: list[str], on: str, span: int) -> DataFrame:
    """df with ahead: rows of the key from this one to span later."""
    return df.withColumn("ahead", F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(on).rangeBetween(0, span)))


def second_difference(df: DataFrame, by: list[str], on: str, value: str, last: int = 12) -> DataFrame:
    """df with miss (distance from the line through the two rows before, scaled for uneven gaps) and noise (1.4826 times its running median)."""
    w = Window.partitionBy(*by).orderBy(on)
    g1, g0 = F.col(on) - F.lag(on, 1).over(w), F.lag(on, 1).over(w) - F.lag(on, 2).over(w)
    k = g1 / g0
    line = F.lag(value, 1).over(w) + (F.lag(value, 1).over(w) - F.lag(value, 2).over(w)) * k
    df = df.withColumn("miss", F.abs(F.col(value) - line) / F.sqrt(1 + (1 + k) * (1 + k) + k * k))
    return df.withColumn("noise", 1.4826 * F.percentile("miss", F.lit(0.5)).over(w.rowsBetween(1 - last, 0)))


def first_window(df: DataFrame, by: str, on: str, value: str, span: int, skip: int, keep: int, rule) -> DataFrame:
    """by, start: the first row, after skip and before keep from the end, from which rule(min, max, count) holds over span."""
    w = Window.partitionBy(by).orderBy(on).rangeBetween(0, span)
    whole = Window.partitionBy(by)
    ok = rule(F.min(value).over(w), F.max(value).over(w), F.count(value).over(w))
    inside = (F.col(on) >= F.min(on).over(whole) + skip) & (F.col(on) + span <= F.max(on).over(whole) - keep)
    return df.withColumn("_ok", ok & inside).where("_ok").groupBy(by).agg(F.min(on).alias("start"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ewma(df: DataFrame, by: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """by, n, ewma: the exponentially smoothed last value, folded in order."""
    g = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    fold = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.get("v", F.lit(0)), lambda s, x: s + alpha * (x - s))
    return g.select(*by, F.size("v").cast("long").alias("n"), fold.alias("ewma"))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as processors divide: over 0 it is NaN or infinite and no error."""
    return F.when(b == 0, a * float("inf")).otherwise(a / F.nullif(b, F.lit(0.0)))


def online_scale(df: DataFrame, by: list[str], order: str, weight: str, ratio: str) -> DataFrame:
    """df with scale: the weighted mean ratio of all rows so far, NaN while all weights are 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"_a": F.sum(F.col(weight) * F.col(ratio)).over(w), "_b": F.sum(weight).over(w)})
    return d.withColumn("scale", quotient(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def prefix_median(df: DataFrame, by: list[str], order: str, value: str, last: int) -> DataFrame:
    return df.withColumn("prefix_median", F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - last, 0)))
