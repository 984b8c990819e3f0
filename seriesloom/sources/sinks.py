"""Writers: union of columns as CSV, canonical JSON lines, filtered copies, idempotent partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in first-seen order, null where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def canonical_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON string per row: keys sorted, NaN as null, doubles to so many significant digits."""
    cols = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
            c = F.when(F.isnan(c), None).when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_new_runs(df: DataFrame, done: DataFrame | None, path: str, key: str = "run") -> None:
    """Write only runs that are not done yet, a partition for each; doing it again adds nothing."""
    fresh = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").partitionBy(key).parquet(path)


def first_seconds(df: DataFrame, us: int, by: str = "run", on: str = "us") -> DataFrame:
    """The rows of each run within so many microseconds of its first."""
    start = df.groupBy(by).agg(F.min(on).alias("_start"))
    return df.join(start, by).where(F.col(on) <= F.col("_start") + us).drop("_start")
