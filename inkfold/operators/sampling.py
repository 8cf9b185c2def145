"""Samples and orders that are the same every time: chance is a seeded hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import natural_key
from inkfold.operators.windows import numbered


def chance(seed: int, *key: Column) -> Column:
    """A text that orders keys at random, given by the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer); ``key`` should be unique."""
    return rows.orderBy(chance(seed, F.col(key)), key).limit(n)


def top_values(frequency: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return frequency.orderBy(F.desc("n"), "value").limit(n)


def by_keys(rows: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    return rows.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])


def by_nature(rows: DataFrame, text: str) -> DataFrame:
    """Rows in the order people expect of names with numbers."""
    return rows.orderBy(natural_key(F.col(text)), text)


def prefix(rows: DataFrame, index: str, n: int) -> DataFrame:
    """The first ``n`` rows by row number: a filter, no sort."""
    return rows.filter(F.col(index) < n)


def by_positions(rows: DataFrame, index: str, wanted: DataFrame, position: str) -> DataFrame:
    """The rows at the wanted positions, once for each time a position is wanted."""
    return wanted.select(F.col(position).alias("_at")).join(rows, F.col("_at") == F.col(index)).drop("_at")


def group_samples(rows: DataFrame, members: DataFrame, group: str, row: str, member: str, low: int = 1, high: int = 8, seed: int = 42, exclude_self: bool = False) -> DataFrame:
    """Rows with ``refs``: between ``low`` and ``high`` members of their group, capped at its size, without replacement.

    The members of each group are numbered; a row draws numbers by seed and row (Floyd's method) and fetches the members of these alone,
    so that a group may be of any size. ``exclude_self`` keeps a row's own member (equal to ``row``) out. Members should be distinct;
    rows of null groups or groups without members get an empty list, repeated rows the same list.
    """
    held = numbered(members.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(member).alias("_m")), [F.col("_g"), F.col("_m")], "_i")
    sizes = held.groupBy("_g").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    asked = rows.select(F.col(row).alias("_row"), F.col(group).alias("_group")).distinct().join(sizes, F.col("_group") == F.col("_g")).drop("_g")
    if exclude_self:
        own = held.select(F.col("_g").alias("_og"), F.col("_m").alias("_om"), F.col("_i").alias("_own"))
        asked = asked.join(own, (F.col("_group") == F.col("_og")) & (F.col("_row") == F.col("_om")), "left").drop("_og", "_om")
        asked = asked.withColumn("_own", F.col("_own") - F.col("_first")).withColumn("_n", F.col("_n") - F.col("_own").isNotNull().cast("int"))
    else:
        asked = asked.withColumn("_own", F.lit(None).cast("bigint"))
    number = lambda digits, *of: F.conv(F.substring(chance(seed, F.col("_row"), *of), 1, digits), 16, 10).cast("bigint")
    k = F.least(F.lit(low) + F.pmod(number(8), F.lit(high - low + 1)), F.col("_n"))
    draw = lambda seen, j, t: F.array_append(seen, F.when(F.array_contains(seen, t), j).otherwise(t))
    floyd = F.aggregate(F.sequence(F.col("_n") - F.col("_k"), F.col("_n") - 1), F.array().cast("array<bigint>"), lambda seen, j: draw(seen, j, F.pmod(number(15, j), j + 1)))
    drawn = asked.withColumn("_k", k).filter("_k > 0").select("_row", "_group", "_first", "_own", F.posexplode(floyd).alias("_nth", "_at"))
    at = F.col("_first") + F.col("_at") + F.coalesce((F.col("_at") >= F.col("_own")).cast("int"), F.lit(0))
    fetched = drawn.select("_row", "_group", "_nth", at.alias("_i")).join(held.select("_i", "_m"), "_i")
    refs = fetched.groupBy("_row", "_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_m"))), lambda x: x["_m"]).alias("refs"))
    kind = dict(members.select(F.array(member).alias("m")).dtypes)["m"]
    joined = rows.join(refs, F.col(row).eqNullSafe(F.col("_row")) & (F.col(group) == F.col("_group")), "left").drop("_row", "_group")
    return joined.withColumn("refs", F.coalesce("refs", F.array().cast(kind)))
