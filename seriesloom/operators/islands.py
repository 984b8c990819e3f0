"""Gaps and islands: runs of a condition, sessions, dwells, bursts, recovery, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """df with a number that grows at every row where breaks holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def changed(by: list[str], order: list, value: str) -> Column:
    """Does value differ from the row before; the first row does."""
    return ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*by).orderBy(*order))) | (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def true_runs(df: DataFrame, by: list[str], order: list, flag: Column, *extra: Column, on: str = "us") -> DataFrame:
    """by, island, start, end, rows (and extra aggregates) of each run of rows where flag holds."""
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    df = numbered(df.withColumn("_new", changed(by, order, "_flag")), by, order, F.col("_new"))
    return df.where("_flag").groupBy(*by, "island").agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count(F.lit(1)).alias("rows"), *extra)


def sessions(df: DataFrame, by: list[str], order: list, gap: int, on: str = "us") -> DataFrame:
    """df with session: a new one after more than gap without a row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return numbered(df.withColumn("_gap", F.col(on) - F.lag(on).over(w) > gap), by, order, F.col("_gap"), "session").drop("_gap")


def recovery(df: DataFrame, by: list[str], good: Column, hold: int, on: str = "us") -> DataFrame:
    """by, start: when the first run of good rows that lasts at least hold begins."""
    runs = true_runs(df, by, [F.col(on)], good, on=on)
    return runs.where(F.col("end") - F.col("start") >= hold).groupBy(*by).agg(F.min("start").alias("start"))


def debounced(df: DataFrame, by: list[str], mode: str, hold: int, on: str = "us") -> DataFrame:
    """df with confirmed: the last mode that had lasted at least hold."""
    order = [F.col(on)]
    df = numbered(df.withColumn("_new", changed(by, order, mode)), by, order, F.col("_new"))
    since = F.min(on).over(Window.partitionBy(*by, "island"))
    df = df.withColumn("_held", F.when(F.col(on) - since >= hold, F.col(mode)))
    return df.withColumn("confirmed", F.last("_held", True).over(Window.partitionBy(*by).orderBy(*order))).drop("_new", "_held")
