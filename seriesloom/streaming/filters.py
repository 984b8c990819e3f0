"""Sigma-point filtering of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class SigmaFilter:
    """An unscented Kalman filter with scalar updates, one measurement at a time.

    f(x, u) moves a state, h(x) is what a sensor sees; an update whose squared,
    scaled innovation is over the gate is refused.
    """

    f: Callable[[np.ndarray, float], np.ndarray]
    x: np.ndarray
    p: np.ndarray
    q: np.ndarray
    gate: float = 9.0
    spread: float = 1.0

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        root = np.linalg.cholesky((n + self.spread) * (self.p + self.p.T) / 2 + 1e-12 * np.eye(n))
        w = np.full(2 * n + 1, 0.5 / (n + self.spread))
        w[0] = self.spread / (n + self.spread)
        return np.vstack([self.x, self.x + root.T, self.x - root.T]), w

    def predict(self, u: float = 0.0) -> None:
        pts, w = self.points()
        moved = np.array([self.f(s, u) for s in pts])
        self.x = w @ moved
        d = moved - self.x
        self.p = (w[:, None] * d).T @ d + self.q

    def update(self, z: float, h: Callable[[np.ndarray], float], r: float) -> bool:
        if z is None or not np.isfinite(z):
            return False
        pts, w = self.points()
        seen = np.array([h(s) for s in pts])
        mean = w @ seen
        s = w @ (seen - mean) ** 2 + r
        if (z - mean) ** 2 > self.gate * s:
            return False
        k = (w * (seen - mean)) @ (pts - self.x) / s
        self.x = self.x + k * (z - mean)
        self.p = self.p - s * np.outer(k, k)
        return True


def sigma_filtered(df: DataFrame, dt: float = 1.0, noise: float = 100.0) -> DataFrame:
    """run, seq, speed, rate, used: a two-state filter (value and its rate, which saturates) over each run."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        flt = SigmaFilter(lambda x, _: np.array([x[0] + dt * 20 * np.tanh(x[1] / 20), 0.9 * x[1]]), np.array([50.0, 0.0]), np.diag([2500.0, 25.0]), np.diag([25.0, 4.0]))
        out = []
        for v in pdf["value"]:
            flt.predict()
            used = flt.update(v, lambda x: x[0], noise)
            out.append((flt.x[0], flt.x[1], used))
        return pd.DataFrame({"run": key[0], "seq": pdf["seq"], "speed": [o[0] for o in out], "rate": [o[1] for o in out], "used": [o[2] for o in out]})

    return df.groupBy("run").applyInPandas(run, "run long, seq long, speed double, rate double, used boolean")
