"""Aggregations: frequencies, distributions, totals, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold import store
from inkfold.operators.windows import running

# The quantiles that length reports show.
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def value_frequency(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, value, n)`` of every distinct value as text; lists count by element, nulls not at all.

    All fields are counted in one pass: a row is exploded to its values, which are summed before the shuffle.
    """
    kinds = dict(rows.dtypes)

    def entries(field: str) -> Column:
        values = F.col(field) if kinds[field].startswith("array") else F.array(field)
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))

    listed = [entries(f) for f in fields]
    empty = F.array().cast("array<struct<field: string, value: string>>")
    every = F.concat(*[F.coalesce(x, empty) for x in listed])
    return rows.select(F.explode(every).alias("x")).filter("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def frequency_summary(frequency: DataFrame) -> DataFrame:
    """For each field: distinct values, occurrences, values that occur once, and occurrences of the others."""
    once = F.col("n") == 1
    return frequency.groupBy("field").agg(F.count("*").alias("unique_count"), F.sum("n").alias("total_occurrences"), F.count_if(once).alias("singletons"), F.coalesce(F.sum(F.when(~once, F.col("n"))), F.lit(0)).alias("repeated_total"))


def sorted_values(frequency: DataFrame) -> DataFrame:
    """One row a field: its values as an array of ``<n, value>``, most frequent first, then by value.

    For fields of few distinct values: the array is one row. ``top_values`` has no such bound.
    """
    entry = F.struct((-F.col("n")).alias("m"), "value")
    return frequency.groupBy("field").agg(F.array_sort(F.collect_list(entry)).alias("x")).select("field", F.transform("x", lambda e: F.struct((-e["m"]).alias("n"), e["value"].alias("value"))).alias("values"))


def list_sizes(rows: DataFrame, field: str) -> DataFrame:
    """``(num, n)``: how many rows have how many elements; null lists have none."""
    return rows.groupBy(F.coalesce(F.size(F.col(field)), F.lit(0)).cast("bigint").alias("num")).agg(F.count("*").alias("n"))


def repeated_values(rows: DataFrame, field: str) -> DataFrame:
    """``(value, n)`` of values that occur more than once."""
    return rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


#: Distinct values that one task may rank.
FEW_VALUES = 100_000


def exact_quantiles(rows: DataFrame, value: Column, at: tuple[float, ...], by: str = "by", few: int = FEW_VALUES) -> DataFrame:
    """``(by, q, value)``: the quantiles of each ``by``, linear between ranks; nulls are left out. ``by`` has few values.

    Equal values are counted before the shuffle. Up to ``FEW_VALUES`` distinct ones are ranked at once; more are summed up over ranges of
    values, and each quantile picks the one or two values that hold its ranks: no task holds a column's values. Either way the result is the same.
    """
    counts = rows.select(F.col(by), value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy(by, "v").agg(F.count("*").alias("n"))
    counts = store.written(counts, "counts")
    if counts.count() <= few:
        found = counts.groupBy(by).agg(F.percentile("v", F.array(*[F.lit(q) for q in at]), F.col("n")).alias("found"))
        return found.select(by, F.posexplode("found").alias("k", "value")).select(by, F.element_at(F.array(*[F.lit(q) for q in at]), F.col("k") + 1).alias("q"), "value")
    summed = running(counts, [F.col(by), F.col("v")], F.col("n"))
    groups = summed.groupBy(F.col(by).alias("_by")).agg(F.min(F.col("upto") - F.col("n")).alias("first"), F.sum("n").alias("total"))
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    wanted = groups.select("_by", "first", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), place(q).alias("place")) for q in at])).alias("w"))
    wanted = wanted.select("_by", "w.q", (F.col("first") + F.floor("w.place")).alias("low"), (F.col("w.place") - F.floor("w.place")).alias("part"))
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    low, high = holds(F.col("low")), holds(F.col("low") + 1) & (F.col("part") > 0)
    picked = summed.join(F.broadcast(wanted), F.col(by).eqNullSafe(F.col("_by")) & (low | high))
    weight = F.when(low, 1 - F.col("part")).otherwise(0.0) + F.when(high, F.col("part")).otherwise(0.0)
    return picked.groupBy(by, "q").agg(F.sum(F.col("v") * weight).alias("value"))


def _one_row(found: DataFrame, at: tuple[float, ...], names: list[str]) -> DataFrame:
    return found.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in zip(at, names, strict=True)])


def scaled_centre(rows: DataFrame, columns: list[str], unit: str, scale: float = 1.0) -> DataFrame:
    """``(column, mean, median)`` of columns given in units of ``unit``, scaled."""
    named = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) / F.col(unit) * F.lit(scale)).alias("v")) for c in columns])
    scaled = rows.select(F.explode(named).alias("x")).select("x.column", "x.v")
    middle = exact_quantiles(scaled, F.col("v"), (0.5,), "column").select(F.col("column").alias("_c"), F.col("value").alias("median"))
    return scaled.groupBy("column").agg(F.avg("v").alias("mean")).join(F.broadcast(middle), F.col("column") == F.col("_c"), "left").drop("_c")


def quantiles(rows: DataFrame, value: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row: ``q25``, ``q50``, ... of a column, linear between ranks; nulls for no rows."""
    return _one_row(exact_quantiles(rows.select(F.lit(0).alias("by"), value), F.col(value), at), at, [f"q{round(q * 100)}" for q in at])


def described(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles, greatest; nulls left out."""
    v, quarters = F.col(value), (0.25, 0.5, 0.75)
    plain = rows.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    inner = _one_row(exact_quantiles(rows.select(F.lit(0).alias("by"), value), v, quarters), quarters, ["q25", "q50", "q75"])
    return plain.crossJoin(F.broadcast(inner)).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: samples, and for each column its sum and its average over the samples."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in columns]
    return rows.agg(F.count("*").alias("samples"), *sums).select("*", *[F.try_divide(F.col(f"{c}_total"), F.col("samples")).alias(f"{c}_avg") for c in columns])


def priced(total: DataFrame, column: str, price: float, per: float = 1e6) -> DataFrame:
    """Totals with cost, cost a sample and cost a thousand samples."""
    cost = F.col(f"{column}_total") / F.lit(per) * F.lit(price)
    return total.withColumn("cost", cost).withColumn("cost_per_sample", F.try_divide(F.col("cost"), F.col("samples"))).withColumn("cost_per_1k", F.col("cost_per_sample") * 1000)


def throughput(rows: DataFrame, usage: str, latency: str, error: Column, concurrency: int = 1) -> DataFrame:
    """One row about answers: rows, errors, rows without usage, token sums (missing ones count 0), and rows and tokens a second.

    Seconds are the latencies' sum over ``concurrency``; without any, rates are null.
    """
    part = lambda name: F.coalesce(F.sum(F.col(f"{usage}.{name}")), F.lit(0)).alias(name)
    seconds = (F.sum(latency) / F.lit(float(concurrency))).alias("seconds")
    total = rows.agg(F.count("*").alias("samples"), F.count_if(error).alias("errors"), F.count_if(F.col(usage).isNull()).alias("missing_usage"), part("prompt_tokens"), part("completion_tokens"), part("total_tokens"), seconds)
    return total.select("*", F.try_divide(F.col("samples"), F.col("seconds")).alias("samples_per_sec"), F.try_divide(F.col("completion_tokens"), F.col("seconds")).alias("tokens_per_sec"))


def split_counts(rows: DataFrame, split: str, failed: Column) -> DataFrame:
    """``(split, num_samples, num_failed_samples)``."""
    return rows.groupBy(split).agg(F.count("*").alias("num_samples"), F.count_if(failed).alias("num_failed_samples"))


def overlap_ratios(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of each side, those on both, and their share of each side; null keys left out."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = sides.filter("k IS NOT NULL").groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    both = seen.agg(n("l", "left_distinct"), n("r", "right_distinct"), n(F.col("l") * F.col("r"), "shared"))
    return both.select("*", F.try_divide(F.col("shared"), F.col("left_distinct")).alias("left_ratio"), F.try_divide(F.col("shared"), F.col("right_distinct")).alias("right_ratio"))


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def accuracy(rows: DataFrame, score: str, taken: str | None = None) -> DataFrame:
    """One row: rows in, rows graded (``score`` isn't null), failed ones, correct ones, and correct over graded (null for none)."""
    graded = F.col(score).isNotNull()
    counted = rows.agg(F.count("*").alias("rows_in"), F.count_if(graded).alias("rows_out"), F.count_if(~graded & (F.col(taken) if taken else F.lit(True))).alias("errors"), F.count_if(graded & F.col(score)).alias("correct"))
    return counted.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("rows_out")))


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """``(size, groups)``: how many groups have how many rows; null is a group."""
    return rows.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def largest_groups(rows: DataFrame, group: str, share: float) -> DataFrame:
    """The largest groups, ``share`` of all of them, at least one; of equal sizes the first by name."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    limit = sizes.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("_limit"))
    cut = sizes.groupBy("n").agg(F.count("*").alias("_groups"))
    before = cut.select(F.col("n").alias("_n"), "_groups", (F.sum("_groups").over(Window.orderBy(F.desc("n"))) - F.col("_groups")).alias("_before"))  # one row a distinct size
    near = sizes.join(before, F.col("n") == F.col("_n")).join(F.broadcast(limit)).filter("_before < _limit")
    inside = F.row_number().over(Window.partitionBy("n").orderBy(group))
    return near.withColumn("_k", F.col("_before") + inside).filter("_k <= _limit").select(group, "n")


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, distinct_values)``, nulls left out: one shuffle over all columns' values."""
    return frequency_summary(value_frequency(rows, columns)).select(F.col("field").alias("column"), F.col("unique_count").alias("distinct_values"))


def distinct_elements(rows: DataFrame, column: str, is_json: bool = False) -> DataFrame:
    """``(element)``: the distinct elements of a list column or of JSON lists in text."""
    listed = F.from_json(column, "array<string>") if is_json else F.col(column)
    return rows.select(F.explode(listed).alias("element")).distinct()


def tag_words(frequency: DataFrame, tag: str = "value", n: str = "n") -> DataFrame:
    """``(word, n)``: each tag and each of its pieces between hyphens and blanks gains the tag's count; a tag of one piece gains it twice."""
    pieces = F.concat(F.array(F.col(tag)), F.filter(F.split(F.col(tag), r"[-\s]+"), lambda w: w != ""))
    return frequency.select(F.explode(pieces).alias("word"), F.col(n).alias("_n")).groupBy("word").agg(F.sum("_n").alias("n"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, lower, n)`` of equal bins over [low, high], the last closed; values outside are in bin 0 and ``bins`` + 1."""
    v, width = F.col(value), (high - low) / bins
    at = F.when(v < low, 0).when(v > high, bins + 1).when(v == high, bins).otherwise(F.floor((v - low) / width) + 1)
    return rows.filter(v.isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"), "n")


def length_distribution(rows: DataFrame, text: str) -> DataFrame:
    return rows.filter(F.col(text).isNotNull()).groupBy(F.length(text).cast("bigint").alias("length")).agg(F.count("*").alias("n"))


def weighted_mean(rows: DataFrame, value: Column, weight: Column, *by: str) -> DataFrame:
    """Sum, count and average of a meter that takes ``weight`` samples at a time."""
    total = rows.groupBy(*by).agg(F.sum(value * weight).alias("sum"), F.sum(weight).alias("count"))
    return total.withColumn("avg", F.try_divide(F.col("sum"), F.col("count")))


def pivoted(rows: DataFrame, index: list[str], name: str, value: str, names: list[str], fill: float | None = None) -> DataFrame:
    """One row an index with a column for each of ``names`` (given, so that no pass is spent on finding them); the first value by size
    of several, null or ``fill`` for none."""
    out = rows.groupBy(*index).pivot(name, names).agg(F.min(value))
    return out if fill is None else out.na.fill(fill, names)


def newline_counts(rows: DataFrame, text: str, marks: dict[str, str] | None = None) -> DataFrame:
    """One row: how often each unusual line end occurs in a text column."""
    # Line separator, paragraph separator, next line.
    marks = marks or {"ls": " ", "ps": " ", "nel": "\u0085"}
    count = lambda m: F.coalesce(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(m), F.lit("")))), F.lit(0))
    return rows.agg(*[count(m).cast("bigint").alias(name) for name, m in marks.items()])


def code_points(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """How many distinct characters the texts of a group have."""
    return rows.select(*by, F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), ""))).alias("_c")).filter("_c <> ''").groupBy(*by).agg(F.countDistinct("_c").alias("code_points"))


def logged_counts(lines: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``(stat, value)``: the number that the last matching line of a log gives for each pattern's first group.

    ``lines`` needs ``row_idx``.
    """
    found = [F.struct(F.lit(name).alias("stat"), F.regexp_extract(text, p, 1).try_cast("bigint").alias("value")) for name, p in patterns.items()]
    hit = lines.select("row_idx", F.explode(F.array(*found)).alias("x")).filter("x.value IS NOT NULL")
    return hit.groupBy("x.stat").agg(F.max_by("x.value", "row_idx").alias("value"))


def matching_counts(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``(stat, n)``: how many rows match each pattern."""
    found = F.array(*[F.struct(F.lit(name).alias("stat"), F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("bigint").alias("hit")) for name, p in patterns.items()])
    return rows.select(F.explode(found).alias("x")).groupBy("x.stat").agg(F.sum("x.hit").alias("n"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
