"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, key: str, by: Column, salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in which the rows of a key are spread over ``salts`` tasks.

    ``by`` tells rows of ``big`` apart. ``small`` is repeated ``salts`` times, so it should be the side of one row a key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def dense_rank_by(rows: DataFrame, key: str, order: list[Column], out: str = "rank", cells: int = 64) -> DataFrame:
    """``rows`` with a number from 0 up, unique and without gaps within ``key``.

    Numbers are given within ``(key, cell)``, a cell being a hash of ``order``, and shifted by the sizes of the cells
    before it: no task sees all rows of a key. Rows equal in ``order`` are numbered in any order among themselves.
    """
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = celled.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), (F.sum("_n").over(Window.partitionBy(key).orderBy("_cell")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order)) - 1
    joined = celled.withColumn("_in", inside).join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn(out, F.col("_start") + F.col("_in")).drop("_k", "_c", "_n", "_in", "_start", "_cell")


#: Keys, and bytes of theirs, that a filtering side may have to be sent to all tasks.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 64_000_000


def filtered_by(big: DataFrame, keys: DataFrame, key: str, *, present: bool = True, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``big`` whose ``key`` is (or, with ``present`` off, isn't) among ``keys``, whose only column it is.

    The keys are counted and weighed first: within ``limit`` and ``BROADCAST_BYTES`` they are broadcast, so that wide rows aren't shuffled;
    beyond it both sides are shuffled. Either way the result is the same.
    """
    weight = F.octet_length(F.col(key).cast("string")) if dict(keys.dtypes)[key] == "string" else F.lit(8)
    known = keys.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    few = known["n"] <= limit and known["bytes"] <= BROADCAST_BYTES
    return big.join(F.broadcast(keys) if few else keys, key, "left_semi" if present else "left_anti")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer parts than the cluster has cores, dealt out to all of them; any larger one as it is.

    For work in Python that costs far more than moving its rows: files of one row group are one task otherwise.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
