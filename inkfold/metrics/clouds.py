"""Distances of point clouds: arrays of ``[x, y]``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_points(flat: Column) -> Column:
    """A flat array x0, y0, x1, y1, ... as an array of points."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.array(F.element_at(flat, 2 * i + 1).cast("double"), F.element_at(flat, 2 * i + 2).cast("double")))


def normalised(points: Column, count: int | None = None) -> Column:
    """Points around the middle of their box, divided by half its longer side.

    Where that can't be done (no extent, no point, a number missing, or not ``count`` points) all points are zeros.
    """
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    low_x, high_x, low_y, high_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    half = F.greatest(high_x - low_x, high_y - low_y) / 2
    moved = F.transform(points, lambda p: F.array((p[0] - (low_x + high_x) / 2) / half, (p[1] - (low_y + high_y) / 2) / half))
    zeros = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), F.lit(count) if count else F.greatest(F.size(points), F.lit(1)))
    sound = (half > 0) & ~F.exists(points, lambda p: p[0].isNull() | p[1].isNull() | F.isnan(p[0]) | F.isnan(p[1]))
    if count:
        sound &= F.size(points) == count
    return F.when(sound, moved).otherwise(zeros)


def chamfer(a: Column, b: Column) -> Column:
    """Mean squared distance to the nearest point of the other cloud, both ways added; in Spark's own expressions."""
    square = lambda p, q: F.pow(p[0] - q[0], 2) + F.pow(p[1] - q[1], 2)
    one_way = lambda x, y: F.aggregate(F.transform(x, lambda p: F.array_min(F.transform(y, lambda q: square(p, q)))), F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return one_way(a, b) + one_way(b, a)


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


def chamfer_of(a: np.ndarray, b: np.ndarray) -> float:
    d = _pairwise(a, b)
    return float(d.min(1).mean() + d.min(0).mean())


def aligned(a: np.ndarray, b: np.ndarray, scale: bool = False, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, bool]:
    """``a`` moved onto ``b`` by iterative closest points, and whether it converged: each round pairs points with their nearest ones and
    takes the rotation, shift and, if wanted, scale of least squares."""
    moved, last = a.copy(), np.inf
    for _ in range(rounds):
        d = _pairwise(moved, b)
        target = b[d.argmin(1)]
        ca, cb = a.mean(0), target.mean(0)
        u, s, vt = np.linalg.svd((a - ca).T @ (target - cb))
        sign = np.ones(len(s))
        sign[-1] = np.sign(np.linalg.det(u @ vt)) or 1
        turn = u @ np.diag(sign) @ vt
        grow = (s * sign).sum() / max(((a - ca) ** 2).sum(), 1e-12) if scale else 1.0
        moved = grow * (a - ca) @ turn + cb
        error = float(((moved - target) ** 2).sum(1).mean())
        if abs(last - error) <= tolerance * max(error, 1e-12) or error < 1e-15:
            return moved, True
        last = error
    return moved, False


def aligned_chamfer(a: Column, b: Column, align: bool = True, scale: bool = False) -> Column:
    """Chamfer distance after alignment; without it where alignment doesn't converge. For large clouds also without alignment: NumPy holds
    one pair's distances at a time."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y) -> float | None:
            if x is None or y is None or not len(x) or not len(y):
                return None
            p, q = np.array([list(v) for v in x], float), np.array([list(v) for v in y], float)
            if align:
                moved, done = aligned(p, q, scale)
                p = moved if done else p
            return chamfer_of(p, q)

        return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return run(a, b)
