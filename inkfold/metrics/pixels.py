"""Differences of images given as arrays of pixel values between 0 and 1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the five scales.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def mean_square(a: Column, b: Column) -> Column:
    """Mean squared difference; null for arrays of different or no length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def signal_to_noise(error: Column) -> Column:
    """PSNR of a mean squared error in decibels, infinite for none."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(1.0) / error))


def _window(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def _smoothed(image: np.ndarray, w: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        image = np.apply_along_axis(np.convolve, axis, image, w, "valid")
    return image


def similarity_parts(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> tuple[float, float]:
    """Mean structural similarity and mean contrast-structure of two grey images; the window shrinks to the image."""
    w = _window(min(size, *a.shape), sigma)
    ma, mb = _smoothed(a, w), _smoothed(b, w)
    va, vb, cov = _smoothed(a * a, w) - ma**2, _smoothed(b * b, w) - mb**2, _smoothed(a * b, w) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    contrast = (2 * cov + c2) / (va + vb + c2)
    return float((contrast * (2 * ma * mb + c1) / (ma**2 + mb**2 + c1)).mean()), float(contrast.mean())


def multi_scale(a: np.ndarray, b: np.ndarray, scales: tuple[float, ...] = SCALES) -> float:
    """Structural similarity over halved images; as many scales as the image allows, weights rescaled to 1."""
    count = max(1, min(len(scales), int(np.log2(min(a.shape)))))
    weights = np.array(scales[:count]) / sum(scales[:count])
    parts = []
    for k in range(count):
        parts.append(max(0.0, similarity_parts(a, b)[1 if k < count - 1 else 0]))
        if k < count - 1:
            half = lambda x: x[: x.shape[0] // 2 * 2, : x.shape[1] // 2 * 2].reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean((1, 3))
            a, b = half(a), half(b)
    return float(np.prod(np.array(parts) ** weights))


def structural_similarity(a: Column, b: Column, height: int, width: int, scales: int = 1) -> Column:
    """SSIM of flat images of a known shape, or over several scales; null where a side is missing."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        one = (lambda x, y: similarity_parts(x, y)[0]) if scales == 1 else (lambda x, y: multi_scale(x, y, SCALES[:scales]))
        shaped = lambda v: np.asarray(v, float).reshape(height, width)
        return pd.Series([None if x is None or y is None else one(shaped(x), shaped(y)) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return run(a, b)
