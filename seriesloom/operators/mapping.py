"""Building a map from tracks: stops, a hybrid of cloud and graph, starts, slips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import islands
from .spatial import around_cells, cell


def stops(df: DataFrame, speed: str, slow: float, hold: int, x: str, y: str) -> DataFrame:
    """run, start, x, y: the median place of each stay of at least hold at less than slow."""
    middle = [F.percentile(c, F.lit(0.5)).alias(c) for c in (x, y)]
    runs = islands.true_runs(df, ["run"], [F.col("us")], F.col(speed) < slow, *middle)
    return runs.where(F.col("end") - F.col("start") >= hold).select("run", "start", x, y)


def shared_stops(found: DataFrame, size: float, least: int) -> DataFrame:
    """cx, cy, x, y, runs: cells where at least so many runs stop."""
    g = found.groupBy(cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    return g.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_distinct("run").alias("runs")).where(F.col("runs") >= least)


def hybrid(cloud: DataFrame, graph: DataFrame, reach: float) -> DataFrame:
    """x, y, weight: graph points with the weights of the cloud points within reach, which they replace, and the other cloud points.

    cloud has (key, x, y, weight), graph (id, x, y); each cloud point goes to its nearest graph point.
    """
    near = around_cells(cloud.select("key", F.col("x").alias("px"), F.col("y").alias("py"), "weight"), "px", "py", reach)
    at = graph.select("id", "x", "y").withColumn("cx", cell(F.col("x"), reach)).withColumn("cy", cell(F.col("y"), reach))
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    hit = near.join(at, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= reach)
    best = hit.groupBy("key", "weight").agg(F.min(F.struct(F.round("d", 9).alias("d"), "id")).alias("b")).select("key", "weight", "b.id")
    weights = best.groupBy("id").agg(F.sum("weight").alias("weight"))
    kept = graph.join(weights, "id", "left").select("x", "y", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return kept.unionByName(cloud.join(best.select("key"), "key", "left_anti").select("x", "y", "weight"))


def starts(df: DataFrame, by: str, order: str, value: str, low: float, high: float, ahead: int, rest: int) -> DataFrame:
    """by, order of each upward crossing of low, with rest rows below before and a row over high within ahead, not counting
    rows within ahead of the start before.  Which rows count depends on the last start, so a key is sequential.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v, found, i = pdf[value].to_numpy(float), [], rest
        while i < len(v):
            if v[i] >= low and (v[i - rest : i] < low).all() and (v[i : i + ahead] > high).any():
                found.append(i)
                i += ahead
            else:
                i += 1
        return pdf.iloc[found][[by, order]]

    return df.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}")


def joint_jumps(df: DataFrame, by: str, on: str, source: str, value: str, least: float, within: int) -> DataFrame:
    """by, on, sources, side: where at least two sources jump by least to the same side within a time, the first row of each."""
    w = Window.partitionBy(by, source).orderBy(on)
    step = F.col(value) - F.lag(value).over(w)
    jumps = df.withColumn("side", F.when(step >= least, 1).when(step <= -least, -1)).where("side is not null")
    ahead = Window.partitionBy(by, "side").orderBy(on).rangeBetween(0, within)
    seen = jumps.withColumn("sources", F.size(F.collect_set(source).over(ahead))).where("sources >= 2")
    return islands.sessions(seen, [by, "side"], [F.col(on)], within, on).groupBy(by, "side", "session").agg(F.min(on).alias(on), F.max("sources").alias("sources")).drop("session")


def straight_ratio(df: DataFrame, by: str, on: str, path: str, x: str, y: str, window: int, straight: float) -> DataFrame:
    """by, n, ratio: the median of path over chord of fixed windows in which the way is straight."""
    g = df.groupBy(by, F.floor(F.col(on) / window).alias("w")).agg(
        (F.max(path) - F.min(path)).alias("path"), F.sqrt((F.max_by(x, on) - F.min_by(x, on)) ** 2 + (F.max_by(y, on) - F.min_by(y, on)) ** 2).alias("chord")
    )
    r = F.col("path") / F.col("chord")
    return g.where((F.col("chord") > 0) & (r < straight)).groupBy(by).agg(F.count("*").alias("n"), F.percentile(r, F.lit(0.5)).alias("ratio"))


def arc_position(line: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Arc length of the nearest point of a small line for each point."""
    a, d = line[:-1], np.diff(line, axis=0)
    arc = np.concatenate([[0], np.cumsum(np.hypot(*d.T))])
    t = np.clip(((px[:, None] - a[:, 0]) * d[:, 0] + (py[:, None] - a[:, 1]) * d[:, 1]) / (d * d).sum(1), 0, 1)
    miss = np.hypot(px[:, None] - a[:, 0] - t * d[:, 0], py[:, None] - a[:, 1] - t * d[:, 1])
    k = miss.argmin(1)
    return arc[k] + t[np.arange(len(k)), k] * (arc[k + 1] - arc[k])
