"""Similarity of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rescaled_cosine(a: Column, b: Column) -> Column:
    """(c + 1) / 2, between 0 and 1."""
    return (cosine(a, b) + 1) / 2


def caption_score(image: Column, text: Column) -> Column:
    """100 times the cosine."""
    return cosine(image, text) * 100


def moments(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """``(by..., n, mean, covariance)``: covariance (n - 1) as a flat array of d * d, both summed in the cluster.

    Each task sums the vectors and outer products it sees and sends one row a group; d * d numbers, whatever the rows.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, s array<double>, q array<double>"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            groups = pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]
            for key, part in groups:
                if len(part):
                    x = np.stack(part[vector].map(np.asarray).tolist()).astype(float)
                    n, s, q = sums.get(key, (0, 0.0, 0.0))
                    sums[key] = n + len(x), s + x.sum(0), q + x.T @ x
        for key, (n, s, q) in sums.items():
            yield pd.DataFrame([[*(key if isinstance(key, tuple) else (key,)), n, s.tolist(), q.ravel().tolist()]], columns=[*by, "n", "s", "q"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.sum())
        s, q = np.sum(np.stack(pdf.s.tolist()), 0), np.sum(np.stack(pdf.q.tolist()), 0).reshape(len(pdf.s.iloc[0]), -1)
        mean = s / n
        covariance = (q - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.full_like(q, np.nan)
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], n, mean.tolist(), covariance.ravel().tolist()]], columns=[*by, "n", "mean", "covariance"])

    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, mean array<double>, covariance array<double>"])
    part = rows.select(*by, vector).mapInPandas(partial, schema)
    return part.groupBy(*(by or [F.lit(0)])).applyInPandas(total, out)


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Distance of two normal distributions: |ma - mb|^2 + tr(Ca + Cb - 2 sqrt(Ca Cb)).

    The trace of the root is taken from the eigenvalues of the symmetric product sqrt(Ca) Cb sqrt(Ca); small negative ones count 0.
    """
    values, vectors = np.linalg.eigh(cov_a)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    inner = np.linalg.eigvalsh(root @ cov_b @ root)
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * np.sqrt(np.clip(inner, 0, None)).sum())


def frechet_column(mean_a: Column, cov_a: Column, mean_b: Column, cov_b: Column) -> Column:
    """``frechet`` over rows of ``moments``."""

    @F.pandas_udf("double")
    def run(ma: pd.Series, ca: pd.Series, mb: pd.Series, cb: pd.Series) -> pd.Series:
        square = lambda c: np.asarray(c, float).reshape(int(len(c) ** 0.5), -1)
        return pd.Series([frechet(np.asarray(a), square(x), np.asarray(b), square(y)) for a, x, b, y in zip(ma, ca, mb, cb, strict=True)])

    return run(mean_a, cov_a, mean_b, cov_b)
