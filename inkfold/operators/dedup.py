"""Keeping one of equal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each content; null content counts as one content.

    Contents are compared as a whole: rows are parted by a digest of 256 bits, not by one that could collide. The rows of a
    content are ranked in one task, but only order and digest are sorted.
    """
    rank = F.row_number().over(Window.partitionBy(F.sha2(content.cast("string"), 256)).orderBy(*order))
    return rows.withColumn("_k", rank).filter("_k = 1").drop("_k")


def kept_keys(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """``(key)``: the smallest key of each content, by partial aggregation: a content that a third of all rows share sends one row a task."""
    return rows.groupBy(F.sha2(content.cast("string"), 256).alias("_h")).agg(F.min(key).alias(key)).select(key)


def conflicting_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one distinct value: none, if the key is a sound hash of the value."""
    return rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo <> hi").select(key)
