"""Signed changes merged into persistent sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold import store


def touched(rows: DataFrame) -> tuple[int, ...]:
    """The buckets of rows: at most as many numbers as there are buckets."""
    return tuple(sorted(r["bucket"] for r in rows.select("bucket").distinct().collect()))


def summed(state: store.State, table: str, delta: DataFrame, key: list[str], sums: list[str], by: list[str], buckets: int) -> store.Change:
    """The change that adds ``delta``, unique in ``key``, to the sums of a table: the buckets it touches are read, summed up and put in
    place; rows whose sums are all 0 are gone. ``by`` are those of the keys that give the bucket."""
    rows = store.written(delta.select(*key, *sums, store.bucket(*by, of=buckets).alias("bucket")), f"{table}-delta")
    hit = touched(rows)
    held = state.read(table, hit)
    if held is not None:
        rows = rows.unionByName(held.withColumn("bucket", store.bucket(*by, of=buckets)))
    now = rows.groupBy("bucket", *key).agg(*[F.sum(c).alias(c) for c in sums])
    left = F.lit(False)
    for c in sums:
        left = left | (F.col(c) != 0)
    return store.Change(now.filter(left), instead=hit)


def merged_in(state: store.State, deltas: dict[str, tuple[DataFrame, list[str], list[str]]], by: list[str], buckets: int, batch: str | None) -> None:
    """Sums of each table changed by its delta ``(rows, key, sums)``, all in one change of the state."""
    state.commit({table: summed(state, table, rows, key, sums, by, buckets) for table, (rows, key, sums) in deltas.items()}, batch)
