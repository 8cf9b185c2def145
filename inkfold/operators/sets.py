"""Set operations on datasets and word lists."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of_all(column: str, *frames: DataFrame) -> DataFrame:
    """The distinct values of a column over all frames."""
    out = frames[0].select(column)
    for frame in frames[1:]:
        out = out.union(frame.select(column))
    return out.distinct()


def words_besides(rows: DataFrame, other: DataFrame, column: str) -> DataFrame:
    return rows.select(column).subtract(other.select(column))


def shared_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """The distinct values that both have; empty if two splits are apart."""
    return left.select(column).intersect(right.select(column))


def both_ways(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``(value, side)``: the distinct values of one side only, ``left`` or ``right``."""
    marked = left.select(F.col(column).alias("value"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.col(column), F.lit(0), F.lit(1)))
    seen = marked.groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l <> r")
    return seen.select("value", F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def equal_as_sets(left: DataFrame, right: DataFrame, column: str) -> bool:
    """Whether both have as many rows and the same distinct values."""
    return left.count() == right.count() and both_ways(left, right, column).isEmpty()


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times."""
    return rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_r") if times > 0 else rows.limit(0)


def joined_by_split(datasets: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Datasets put behind each other for each split of the first; a dataset that lacks one raises."""
    out = dict(datasets[0])
    for other in datasets[1:]:
        for split in out:
            out[split] = out[split].unionByName(other[split])
    return out


def mixed(first: DataFrame, second: DataFrame, times: int = 5) -> DataFrame:
    """The first dataset and ``times`` times the second."""
    return first.unionByName(repeated(second, times))


def sorted_words(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def alphanumeric_contents(spark: SparkSession) -> DataFrame:
    """The 64 single characters: letters, digits, hyphen, apostrophe."""
    return spark.createDataFrame([(c,) for c in string.ascii_letters + string.digits + "-'"], "content string")


# Letters of the block that are ligatures or letters of their own, and the one pair from beyond it.
UNACCENTED, HOOKED = "ÆÐÞßæðþĲĳŊŋŒœſ", "Ƒƒ"


def accented_contents(spark: SparkSession) -> DataFrame:
    """The 178 Latin letters with marks, bars, hooks or without their dot: those of U+00C0 to U+017F that aren't ``UNACCENTED``, and ``HOOKED``."""
    found = [chr(n) for n in range(0xC0, 0x180) if unicodedata.category(chr(n))[0] == "L" and chr(n) not in UNACCENTED]
    return spark.createDataFrame([(c,) for c in [*found, *HOOKED]], "content string")


def listed_words(rows: DataFrame, text: str) -> DataFrame:
    """``(content)``: the distinct words of texts parted by white space."""
    return rows.select(F.explode(F.split(F.trim(text), r"(?U)\s+")).alias("content")).filter("content <> ''").distinct()
