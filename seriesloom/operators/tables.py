"""Fitting a table over two axes: bilinear least squares from one aggregate, smoothness, signs.

Each row falls into one cell of the grid and touches its four corners.  The
aggregate has one row per cell: ten products of weights, four of weights with
the target, and a count.  Only that, bounded by the grid, reaches the driver,
where the normal equations are put together and solved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]
PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]


def place(x: Column, grid: list[float]) -> tuple[Column, Column]:
    """The grid interval of x, clamped to the grid, and how far into it x lies."""
    x = F.least(F.greatest(x, F.lit(float(grid[0]))), F.lit(float(grid[-1])))
    k = F.lit(0)
    for i, g in enumerate(grid[1:-1], 1):
        k = F.when(x >= g, i).otherwise(k)
    low = F.element_at(F.array(*(F.lit(float(g)) for g in grid)), k + 1)
    return k, (x - low) / (F.element_at(F.array(*(F.lit(float(g)) for g in grid)), k + 2) - low)


def cells(df: DataFrame, u: Column, v: Column, y: Column, grid_u: list[float], grid_v: list[float]) -> DataFrame:
    """cu, cv, n, p0 to p9 and r0 to r3: what the rows of each cell add; rows with a null count for nothing."""
    iu, wu = place(u.cast("double"), grid_u)
    iv, wv = place(v.cast("double"), grid_v)
    d = df.where(u.isNotNull() & v.isNotNull() & y.isNotNull()).select(iu.alias("cu"), wu.alias("wu"), iv.alias("cv"), wv.alias("wv"), y.cast("double").alias("y"))
    w = [(F.col("wu") if a else 1 - F.col("wu")) * (F.col("wv") if b else 1 - F.col("wv")) for a, b in CORNERS]
    sums = [F.sum(w[a] * w[b]).alias(f"p{k}") for k, (a, b) in enumerate(PAIRS)] + [F.sum(x * F.col("y")).alias(f"r{k}") for k, x in enumerate(w)]
    return d.groupBy("cu", "cv").agg(F.count("*").alias("n"), *sums)


def equations(found: DataFrame, nu: int, nv: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The normal matrix, the right-hand side and the number of rows."""
    a, b, n = np.zeros((nu * nv, nu * nv)), np.zeros(nu * nv), 0
    for r in found.collect():  # a row a cell of the grid
        at = [(r.cu + i) * nv + r.cv + j for i, j in CORNERS]
        n += r.n
        for k, (p, q) in enumerate(PAIRS):
            a[at[p], at[q]] += r[f"p{k}"]
            if p != q:
                a[at[q], at[p]] += r[f"p{k}"]
        for k in range(4):
            b[at[k]] += r[f"r{k}"]
    return a, b, n


def smoothness(grid_u: list[float], grid_v: list[float], along_u: float, along_v: float) -> np.ndarray:
    """The quadratic form of weighted differences of neighbours; rows on both sides of u = 0 are not drawn together."""
    nu, nv = len(grid_u), len(grid_v)
    node = np.arange(nu * nv).reshape(nu, nv)
    joined = [(node[i, j], node[i, j + 1], along_v) for i in range(nu) for j in range(nv - 1)]
    joined += [(node[i, j], node[i + 1, j], along_u) for i in range(nu - 1) if not grid_u[i] < 0 <= grid_u[i + 1] for j in range(nv)]
    out = np.zeros((nu * nv, nu * nv))
    for a, b, w in joined:
        out[[a, b], [a, b]] += w * w
        out[[a, b], [b, a]] -= w * w
    return out


def fitted_table(df: DataFrame, u: Column, v: Column, y: Column, grid_u: list[float], grid_v: list[float], smooth: tuple[float, float] = (0.3, 0.3), per: float = 1e4, ridge: float = 1e-9) -> np.ndarray:
    """The table of y over grid_u x grid_v; smoothness weighs as if it were seen once every `per` rows."""
    a, b, n = equations(cells(df, u, v, y, grid_u, grid_v), len(grid_u), len(grid_v))
    form = smoothness(grid_u, grid_v, *smooth) * (n / per) + ridge * np.eye(len(b))
    return np.linalg.solve(a + form, b).reshape(len(grid_u), len(grid_v))


def sign_constrained(table: np.ndarray, grid_u: list[float]) -> np.ndarray:
    """Rows above u = 0 no lower than the row of u = 0, those below it no higher."""
    u = np.asarray(grid_u)[:, None]
    coast = table[int(np.argmin(np.abs(grid_u)))]
    return np.where(u > 0, np.maximum(table, coast), np.where(u < 0, np.minimum(table, coast), table))


def predicted(df: DataFrame, table: np.ndarray, u: Column, v: Column, grid_u: list[float], grid_v: list[float], name: str) -> DataFrame:
    """df with the table's bilinear value; null where u or v is."""
    iu, wu = place(u.cast("double"), grid_u)
    iv, wv = place(v.cast("double"), grid_v)
    flat = F.array(*(F.lit(float(x)) for x in table.ravel()))
    at = lambda a, b: F.element_at(flat, ((iu + a) * len(grid_v) + iv + b + 1).cast("int"))
    value = sum(((wu if a else 1 - wu) * (wv if b else 1 - wv) * at(a, b) for a, b in CORNERS), F.lit(0.0))
    return df.withColumn(name, F.when(u.isNotNull() & v.isNotNull(), value))


def as_rows(spark, table: np.ndarray, grid_u: list[float], grid_v: list[float]) -> DataFrame:
    """u, v, value of every node."""
    return spark.createDataFrame([(float(a), float(b), float(table[i, j])) for i, a in enumerate(grid_u) for j, b in enumerate(grid_v)], "u double, v double, value double")
