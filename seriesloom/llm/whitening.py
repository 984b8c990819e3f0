"""Whitening of embeddings by their principal components.

Fit.  Components are found by a randomised range finder: a block of random
directions, some more than are wanted, is multiplied by the covariance in a
pass over all centred rows, made orthonormal and multiplied again (power
passes).  Every pass also gives the Rayleigh-Ritz values and vectors of the
block and their residuals.  Where the residuals will not fall to rounding level
within the passes allowed, as with a flat spectrum, the block grows to the full
dimension, and one more pass gives the whole projected covariance.  A pass is
one aggregate: each task sums its rows, Spark sums the tasks, and only matrices
of (dimension x block) numbers reach the driver.

Rows.  A null vector, one with a null or non-finite entry, one without entries
or with an entry beyond 2**40 takes no part, nor do vectors of another length
than the commonest (of equally common ones the longest).  Every other row does,
with or without an id, repeated or not, and each gives its own results.  A
component whose variance is at rounding level cannot be scaled to one and is
left out, so equal vectors, or a single one, have no components and no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this take no part; rows handled at once, so that sums of whole numbers fit 64 bits.
LARGEST, ROWS = 2.0**40, 2048
#: Directions beside those wanted, power passes at most, and the residual at rounding level (as a share of the largest variance).
OVERSAMPLE, PASSES, RESIDUAL = 10, 4, 1e-13
#: Variances below this share of the largest are rounding errors.
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """What is fitted: n rows, the sums of their whole-number entries, the variances and unit vectors of components (falling), the trace."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray  # one row a component
    trace: float
    full: bool  # whether the block had to grow to the full dimension
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """The whole part of each mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums leave beyond n times the whole part, from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)


def whole_rows(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which rows take part, as positions, and their vectors as whole numbers; some rows at a time."""
    for a in range(0, len(column), ROWS):
        part = column.slice(a, ROWS)
        at = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(part).fill_null(-1), width)))
        values = np.asarray(part.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
        good = (np.abs(values) <= LARGEST).all(axis=1)  # neither nan nor infinite
        if good.any():
            yield at[good] + a, np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x less the means, without the rounding that the large means would bring."""
    return (x - base) - rest / n


def sums_of(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows take part and the exact sums of their entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for at, x in whole_rows(batch.column(0), width):
                n += len(at)
                total = [s + t for s, t in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int64()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "v"])

    found = vectors.mapInArrow(add, "i long, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    by = {r.i: int(r.v) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def matrix_sum(vectors: DataFrame, width: int, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum of a matrix over all rows: add(total, x) adds what some rows give to a task's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, x in whole_rows(batch.column(0), width):
                add(total, x)
        flat = total.ravel()
        for a in range(0, len(flat), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(a + (1 << 16), len(flat)))), pa.array(flat[a : a + (1 << 16)])], ["at", "v"])

    found = vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[np.asarray(found["at"])] = np.asarray(found["v"])
    return out.reshape(shape)


def covariance_times(vectors: DataFrame, n: int, sums: list[int], block: np.ndarray | None) -> tuple[np.ndarray, float]:
    """The covariance times a block of directions (None: all of them, so the covariance itself), and its trace."""
    width = len(sums)
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    columns = width if block is None else block.shape[1]

    def add(total: np.ndarray, x: np.ndarray) -> None:
        b = centred(x, base, rest, n)
        total[:-1] += b.T @ (b if block is None else b @ block)
        total[-1, 0] += (b * b).sum()

    out = matrix_sum(vectors, width, (width + 1, columns), add) / n
    return out[:-1], float(out[-1, 0])


def ritz(block: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values and vectors (rows) of the covariance within an orthonormal block, falling, and the largest residual of those wanted, as a share of the largest value."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    left = np.linalg.norm(image @ turn - block @ turn * values, axis=0)[:wanted]
    return values, (block @ turn).T, float(left.max() / max(values[0], np.finfo(float).tiny))


def fit(embeddings: DataFrame, column: str = "embedding", wanted: int = 32, oversample: int = OVERSAMPLE, passes: int = PASSES, residual: float = RESIDUAL, seed: int = 0) -> Whitening | None:
    """The whitening of all rows of embeddings that take part; None if there are none."""
    vectors = embeddings.select(F.col(column).cast("array<double>").alias("v"))
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).where("d > 0").orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return None
    width = lengths.d
    n, sums = sums_of(vectors, width)
    if not n:
        return None
    k, size = min(wanted, width), min(wanted + oversample, width)
    full, before, trace = size == width, None, 0.0
    if not full:
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
        block = np.linalg.qr(covariance_times(vectors, n, sums, block)[0])[0]
        for left in reversed(range(passes)):
            image, trace = covariance_times(vectors, n, sums, block)
            values, found, now = ritz(block, image, k)
            if now <= residual:
                break
            # at the rate seen so far, would the passes that are left be enough?
            if not left or (before is not None and now * min(now / before, 1.0) ** left > residual):
                full = True
                break
            before, block = now, np.linalg.qr(image)[0]
    if full:
        image, trace = covariance_times(vectors, n, sums, None)
        values, found, _ = ritz(np.eye(width), image, k)
    keep = values[:k] > NO_VARIANCE * max(trace, 0.0)
    model = Whitening(n, sums, values[:k][keep], found[:k][keep], trace, full)
    model.identity_error = identity_error(vectors, model)
    return model


def whitened(x: np.ndarray, model: Whitening, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return centred(x, base, rest, model.n) @ model.components.T / np.sqrt(model.variances)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the covariance of all whitened rows less the identity; one more pass."""
    k, base, rest = len(model.variances), model.base, model.rest
    if not k:
        return 0.0

    def add(total: np.ndarray, x: np.ndarray) -> None:
        w = whitened(x, model, base, rest)
        total[:-1] += w.T @ w
        total[-1] += w.sum(axis=0)

    out = matrix_sum(vectors, len(model.sums), (k + 1, k), add) / model.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k)).max())


def deviations(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Per row the exact sum of (n x - S)**2; None where it passes 64 bits."""
    far = int(np.abs(x - base).max(initial=0)) + 1
    if (far * n + n) ** 2 * x.shape[1] < 1 << 63:
        own = (x - base) * n - rest
        return (own * own).sum(axis=1).tolist()
    own = (x - base).astype(object) * n - rest.astype(object)
    return [v if v < 1 << 63 else None for v in (own * own).sum(axis=1).tolist()]


def transform(embeddings: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, deviation and whitened (one entry a component) of each row that takes part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    base, rest, width, k = model.base, model.rest, len(model.sums), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_rows(batch.column(1), width):
                w = whitened(x, model, base, rest)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * k + 1, k) if k else np.zeros(len(at) + 1, np.int64), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviations(x, base, rest, model.n), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitening_table(embeddings: DataFrame, wanted: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that takes part and each component."""
    model = fit(embeddings, wanted=wanted)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.variances)).cast("array<double>")
    rows = transform(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
