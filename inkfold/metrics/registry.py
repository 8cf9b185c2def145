"""Metrics by name: each a column a row and how rows are summed up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.metrics import clouds, pixels, vectors


@dataclass(frozen=True)
class Metric:
    """``of`` gives a row's value; rows whose value is null, NaN or infinite are left out of the mean, not out of the rows."""

    of: Callable[..., Column]
    columns: tuple[str, ...]


METRICS: dict[str, Metric] = {
    "l2": Metric(pixels.mean_square, ("predict_pixels", "label_pixels")),
    "psnr": Metric(lambda a, b: pixels.signal_to_noise(pixels.mean_square(a, b)), ("predict_pixels", "label_pixels")),
    "dino": Metric(vectors.rescaled_cosine, ("predict_features", "label_features")),
    "clip": Metric(vectors.caption_score, ("image_features", "text_features")),
    "chamfer": Metric(clouds.chamfer, ("predict_points", "label_points")),
}


def register(name: str, of: Callable[..., Column], *columns: str) -> None:
    """Make a metric known under a name; a known name raises."""
    if name in METRICS:
        raise ValueError(f"{name} is registered already")
    METRICS[name] = Metric(of, columns)


def scored(rows: DataFrame, names: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """Rows with a column for each metric; ``columns`` says where its inputs are called otherwise."""
    where = columns or {}
    return rows.select("*", *[METRICS[n].of(*[F.col(where.get(c, c)) for c in METRICS[n].columns]).alias(n) for n in names])


def summed_up(scores: DataFrame, names: list[str], *by: str) -> DataFrame:
    """The mean of each metric over its finite values, how many they are, and, with l2, the PSNR of its mean."""
    fine = lambda n: F.when(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != F.lit(float("inf"))), F.col(n))
    out = scores.groupBy(*by).agg(F.count("*").alias("rows"), *[a for n in names for a in (F.avg(fine(n)).alias(n), F.count(fine(n)).alias(f"{n}_rows"))])
    return out.withColumn("psnr_of_mean", pixels.signal_to_noise(F.col("l2"))) if "l2" in names else out
