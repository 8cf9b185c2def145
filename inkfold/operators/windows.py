"""Row numbers, chunks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold import store


def _ranged(rows: DataFrame, order: list[Column], extra: dict[str, Column], name: str) -> DataFrame:
    """Rows parted by ranges of the order and sorted within, stored with ``_part`` and ``extra``: bounds of ranges are drawn anew each
    time a plan runs, so what is joined by part must come from one run."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return store.written(placed.withColumns({"_part": F.spark_partition_id()} | extra), name)


def _shifted(stored: DataFrame, amount: Column, inside: Column, out: str) -> DataFrame:
    """``inside`` plus the sums of ``amount`` of all parts before a row's."""
    sums = stored.groupBy(F.col("_part").alias("_p")).agg(F.sum(amount).alias("_n"))
    starts = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))  # one row a part
    return stored.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(out, F.col("_start") + inside).drop("_part", "_p", "_in", "_start")


def numbered(rows: DataFrame, order: list[Column], out: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task seeing all rows.

    Rows are range-parted by the order and stored, counted a part, and numbered within their part, shifted by the parts before. ``order``
    should be unique; rows equal in it are numbered in any order.
    """
    inside = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    return _shifted(_ranged(rows, order, {"_in": inside}, "numbered"), F.lit(1), F.col("_in"), out)


#: Rows up to which the first ones are found by a top-n of each part; more are taken by their number.
TOP = 100_000


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a total order."""
    if n <= TOP:
        return rows.orderBy(*order).limit(n)
    return numbered(rows, order, "_i").filter(F.col("_i") < n).drop("_i")


def running(rows: DataFrame, order: list[Column], amount: Column, out: str = "upto") -> DataFrame:
    """Rows with the sum of ``amount`` over all rows up to them in a total order, without one task seeing all rows.

    Range-parted like ``numbered``: sums within a part, shifted by those of the parts before. ``order`` should be unique.
    """
    stored = _ranged(rows, order, {}, "running")
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _shifted(stored.withColumn("_in", inside), amount, F.col("_in"), out)


def chunked(rows: DataFrame, index: str, size: int, out: str = "chunk") -> DataFrame:
    """The number of the chunk of ``size`` rows that a row number falls into."""
    return rows.withColumn(out, F.floor(F.col(index) / size).cast("bigint"))


def sharded(rows: DataFrame, index: str, shards: int, out: str = "shard") -> DataFrame:
    return rows.withColumn(out, F.pmod(F.col(index), F.lit(shards)).cast("bigint"))


def page(rows: DataFrame, index: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows that have a row number."""
    return rows.filter(F.col(index).between((number - 1) * size, number * size - 1))


def head_of_each(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the limit is the operator."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as an aggregation: partial sums before the shuffle, no sort."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(key, "_r.*")
