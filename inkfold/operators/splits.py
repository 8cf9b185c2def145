"""Splits without leaks: whole groups go to a split, drawn by a seeded hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.sampling import chance
from inkfold.operators.windows import first_rows, numbered

TRAIN, IND, OOD, DEV = "train", "ind_test", "ood_test", "dev"


def checked(total: int, n_ood: int, n_ind: int, n_dev: int, n_train: int | None = None) -> None:
    """Raises unless the sizes can be drawn from ``total``."""
    given = [n for n in (n_ood, n_ind, n_dev, n_train) if n is not None]
    train = total - n_ood if n_train is None else n_train
    if min(given) < 0 or n_ood > total or train > total - n_ood or max(n_ind, n_dev) > train:
        raise ValueError(f"splits of {n_ood} outside, {train} in train, {n_ind} and {n_dev} of them can't be drawn from {total}")


def drawn(groups: DataFrame, key: str, n_ood: int, n_ind: int, n_dev: int, n_train: int | None = None, seed: int = 42) -> DataFrame:
    """``(key, split)`` for distinct keys: ``ood_test`` apart from ``train``; ``ind_test`` and ``dev`` are drawn from train, so a
    key of theirs has a row for each of its splits.

    Keys stand in the order of a hash. The small splits are its first keys; ranks over all are given by ranges.
    """
    checked(groups.count(), n_ood, n_ind, n_dev, n_train)
    order = lambda salt: [chance(seed + salt, F.col(key)), F.col(key)]
    named = lambda keys, name: keys.select(key, F.lit(name).alias("split"))
    outside = first_rows(groups.select(key), order(0), n_ood)
    if n_train is None:
        train = groups.select(key).join(outside, key, "left_anti")
    else:
        train = numbered(groups.select(key), order(0), "_r").filter(F.col("_r").between(n_ood, n_ood + n_train - 1)).select(key)
    parts = [named(train, TRAIN), named(outside, OOD), named(first_rows(train, order(1), n_ind), IND), named(first_rows(train, order(2), n_dev), DEV)]
    return reduce(DataFrame.unionByName, parts)


def with_splits(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Every row once for each split of its group."""
    return rows.join(splits, key)


def hashed(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows with ``split`` by the hash of their group alone: no count, no join, the same for later rows of the group."""
    at = F.conv(F.substring(chance(seed, F.col(key)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    upto, split = 0.0, None
    for name, share in shares.items():
        upto += share
        split = F.when(at < upto, name) if split is None else split.when(at < upto, name)
    return rows.withColumn("split", split.otherwise(list(shares)[-1]))


def violations(splits: DataFrame, key: str) -> DataFrame:
    """``(rule, n)``: keys in train and in ood_test; keys of ind_test and of dev that aren't in train. All should be 0."""
    has = lambda s: F.max(F.when(F.col("split") == s, 1).otherwise(0))
    flags = splits.groupBy(key).agg(has(TRAIN).alias("t"), has(OOD).alias("o"), has(IND).alias("i"), has(DEV).alias("d"))
    rules = {"train_and_ood": (F.col("t") == 1) & (F.col("o") == 1), "ind_not_train": (F.col("i") == 1) & (F.col("t") == 0), "dev_not_train": (F.col("d") == 1) & (F.col("t") == 0)}
    wide = flags.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("x")).select("x.rule", "x.n")


def assert_sound(splits: DataFrame, key: str) -> None:
    """Raises on the violations that leak; a dev key outside of train is only reported by ``violations``."""
    found = {r["rule"]: r["n"] for r in violations(splits, key).collect()}
    if found["train_and_ood"] or found["ind_not_train"]:
        raise ValueError(f"splits leak: {found}")
