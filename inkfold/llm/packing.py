"""Problem 8: items into containers of a fixed capacity, never splitting one that fits.

Sizes are whole numbers up to the capacity, so an instance is a count of items by size: at most ``capacity`` numbers,
however many items there are. On these counts Martello and Toth's reduction fixes item sets that dominate every other
set with their largest item, and what it leaves is packed best fit, largest first. The outcome is a list of patterns (which
sizes share a container, and how often); items then take their places by their number among the items of
their size, which needs no task to see all items of a size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm import tokens
from inkfold.operators.skew import dense_rank_by

#: Rows of five numbers, a size in a pattern, that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_SLOTS = 200_000
Pattern = tuple[int, ...]  # the sizes in one container, largest first


class _Sizes:
    """Counts by size with the sizes that are left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, pattern: Pattern, times: int) -> None:
        for s in pattern:
            self.n[s] -= times
            if not self.n[s]:
                del self.n[s]
                self.order.remove(s)

    def largest_upto(self, room: int, besides: Counter) -> int | None:
        """The largest size up to ``room`` that is left besides the items of ``besides``."""
        for k in range(bisect_right(self.order, room) - 1, -1, -1):
            if self.n[self.order[k]] > besides[self.order[k]]:
                return self.order[k]
        return None

    def smallest_sum(self, k: int, besides: Counter) -> float:
        """The sum of the ``k`` smallest items besides those of ``besides``; infinite if there are fewer."""
        total = 0
        for s in self.order:
            have = min(k, self.n[s] - besides[s])
            total, k = total + have * s, k - have
            if not k:
                return total
        return float("inf")

    def best_pair(self, room: int, besides: Counter) -> tuple[int, Pattern, int]:
        """The largest sum of two items that fit, such a pair, and the largest that the smaller of two fitting items can be."""
        best, pair, smaller = 0, (), 0
        for s in reversed(self.order[: bisect_right(self.order, room // 2)]):
            if self.n[s] <= besides[s]:
                continue
            other = self.largest_upto(room - s, besides + Counter({s: 1}))
            if other is not None and other >= s:
                smaller = max(smaller, s)
                if s + other > best:
                    best, pair = s + other, (other, s)
        return best, pair, smaller


def _times(pattern: Pattern, sizes: _Sizes) -> int:
    return min(sizes.n[s] // k for s, k in Counter(pattern).items())


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns that some best packing has, with how often, and the counts that are left.

    For the items j from the largest down, with R the room beside j and i the largest item that fits R:
    nothing fits R: {j}; i fills R, or no two others fit R: {j, i}; no three others fit R and i is at least as large as any
    two that fit: {j, i}; no three fit, and the best pair is i with an item at least as large as the smaller one of any
    fitting pair: {j, i, it}. Each of these dominates all sets with j, and stays so while its items last.
    """
    sizes, fixed = _Sizes(counts), []
    for j in sorted(sizes.n, reverse=True):
        while sizes.n.get(j, 0):
            room, one = capacity - j, Counter({j: 1})
            i = sizes.largest_upto(room, one)
            if i is None:
                pattern: Pattern = (j,)
            elif i == room or sizes.smallest_sum(2, one) > room:
                pattern = (j, i)
            elif sizes.smallest_sum(3, one) > room:
                best, pair, smaller = sizes.best_pair(room, one)
                if i >= best:
                    pattern = (j, i)
                elif pair[0] == i and pair[1] >= smaller:
                    pattern = (j, *pair)
                else:
                    break
            else:
                break
            times = _times(pattern, sizes)
            fixed.append((tuple(sorted(pattern, reverse=True)), times))
            sizes.take(pattern, times)
    return fixed, sizes.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, largest first, for counts by size: each item goes where it leaves the least room."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        for room in sorted(r for r in open_ if r >= s):
            if not n:
                break
            fit, bins, open_[room] = room // s, open_[room], []
            for pattern, k in bins:
                full = min(k, n // fit)
                if full:
                    open_[room - fit * s].append((pattern + (s,) * fit, full))
                n, k = n - full * fit, k - full
                if k and n:  # fewer than fit are left
                    open_[room - n * s].append((pattern + (s,) * n, 1))
                    n, k = 0, k - 1
                if k:
                    open_[room].append((pattern, k))
        fit = capacity // s
        if n // fit:
            open_[capacity - fit * s].append(((s,) * fit, n // fit))
        if n % fit:
            open_[capacity - n % fit * s].append(((s,) * (n % fit), 1))
    return [b for bins in open_.values() for b in bins]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each occurs, for items of sizes 1 to ``capacity``."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    fixed, rest = reduce_dominated(counts, capacity)
    merged: Counter = Counter()
    for pattern, times in [*fixed, *best_fit(rest, capacity)]:
        merged[pattern] += times
    return sorted(merged.items(), reverse=True)


def pack(rows: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``(key, part, start, size, container)``: one row for each piece of each row.

    A row of a size above the capacity is cut into pieces of the capacity and one of the rest; all others are one piece
    (part 0). ``start`` is where the piece begins. Rows of size 0, null or below take no room: their container is null.
    Equal keys are packed as different items. Containers are numbered from 0 without gaps.
    """
    spark = rows.sparkSession
    amount = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(F.col("_amount") / capacity).cast("bigint") - 1, F.lit(0))
    pieces = rows.select(F.col(key).alias("_key"), amount.alias("_amount")).select("_key", "_amount", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    pieces = pieces.select("_key", "part", (F.col("part") * capacity).alias("start"), F.least(F.col("_amount") - F.col("part") * capacity, F.lit(capacity)).alias("size"))
    pieces = store.written(pieces, "pieces")
    counts = {r["size"]: r["count"] for r in pieces.filter("size > 0").groupBy("size").count().collect()}  # at most capacity rows
    slots, base, seen = [], 0, Counter()
    for pattern, times in plan(counts, capacity):
        for s, each in Counter(pattern).items():
            slots.append((s, seen[s], seen[s] + each * times, each, base))
            seen[s] += each * times
        base += times
    places = spark.createDataFrame(slots, "s bigint, lo bigint, hi bigint, each bigint, base bigint")
    if len(slots) <= BROADCAST_SLOTS:
        places = F.broadcast(places)
    numbered = dense_rank_by(pieces.filter("size > 0"), "size", [F.col("_key"), F.col("part")], "rank")
    placed = numbered.join(places, (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    packed = placed.select("_key", "part", "start", "size", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("bigint").alias("container"))
    nothing = pieces.filter("size = 0").select("_key", "part", "start", "size", F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(nothing).withColumnRenamed("_key", key)


def pack_texts(rows: DataFrame, key: str, text: str, capacity: int = 2048, name: str = "byte_bpe_50k", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """``pack`` for texts sized in tokens of a public tokenizer; ``start`` and ``size`` are in tokens."""
    sized = tokens.encode(rows.select(key, text), key, text, "_ids", name, folder, keep=[key]).select(key, F.size("_ids").cast("bigint").alias("_tokens"))
    return pack(sized, key, "_tokens", capacity)


def usage(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least containers that their sum allows, and the share of room left unused."""
    total = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.try_subtract(F.lit(1.0), F.try_divide(F.col("tokens"), F.col("containers") * capacity)).alias("unused"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_texts(docs, "doc_id", "text")


QUERIES = {"p8_containers": p8_containers}
ORACLES: dict[str, str] = {}
