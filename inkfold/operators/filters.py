"""Filters: each takes a frame and gives the rows that stay."""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import contains_any, without_space
from inkfold.operators.aggregates import quantiles

# What marks a font made for a special purpose, in its file name.
SPECIAL = ("barcode", "symbol", "emoji", "redacted", "block", "musical", "music", "math", "decorative", "blank", "flowcircular", "flowrounded", "linefont", "wavefont", "yarndings")
#: Characters that a usable font must have.
REQUIRED = string.ascii_letters + string.digits + "-'"


def typed_and_hashed(rows: DataFrame, kind: str, digest: str, wanted: str = "ttf") -> DataFrame:
    """Rows of exactly the wanted type that have a digest."""
    return rows.filter((F.col(kind) == wanted) & F.col(digest).isNotNull())


def name_holds_any(path: Column, marks: tuple[str, ...] = SPECIAL) -> Column:
    """Whether the last part of a path holds one of the marks, letter case aside."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.rlike("|".join(re.escape(m) for m in marks))


def covers(codepoints: Column, required: str = REQUIRED) -> Column:
    """Whether an array of characters has all required ones; null covers nothing."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), codepoints)) == 0, F.lit(False))


def text_covers(text: Column, required: str) -> Column:
    """Whether all required characters occur in a text."""
    return covers(F.array_distinct(F.split(text, "")), required)


def without_listed(rows: DataFrame, denied: DataFrame, key: str, denied_key: str | None = None) -> DataFrame:
    """Rows whose key isn't in the deny list; rows with a null key stay."""
    listed = denied.select(F.col(denied_key or key).alias("_denied")).distinct()
    return rows.join(listed, F.col(key) == F.col("_denied"), "left_anti")


def usable(rows: DataFrame, name: str, characters: str, denied: DataFrame | None = None, required: str = REQUIRED) -> DataFrame:
    """Rows that no rule excludes: special purpose by name, missing characters, deny list."""
    kept = rows.filter(~F.coalesce(name_holds_any(F.col(name)), F.lit(False)) & covers(F.col(characters), required))
    return kept if denied is None else without_listed(kept, denied, name)


def below_quantile(rows: DataFrame, length: str, q: float = 0.9) -> DataFrame:
    """Rows with 0 < length < the q-quantile of all rows' lengths, zeros counted, linear between ranks."""
    limit = quantiles(rows, length, (q,)).toDF("_limit")
    return rows.join(F.broadcast(limit), (F.col(length) > 0) & (F.col(length) < F.col("_limit"))).drop("_limit")


def at_most(rows: DataFrame, count: Column, limit: int) -> DataFrame:
    """Rows whose count is known and at most the limit."""
    return rows.filter(count <= limit)


def length_report(rows: DataFrame, count: Column, limit: int, by: str | None = None) -> DataFrame:
    """Rows in, out, removed and invalid (null), with the removed share in percent, for each ``by`` and overall (null).

    A null ``by`` is its own group, told apart from the total by ``is_total``.
    """
    marked = rows.select(*([by] if by else []), count.alias("_n"))
    counters = [F.count("*").alias("rows_in"), F.count_if(F.col("_n") <= limit).alias("rows_out"), F.count_if(F.col("_n") > limit).alias("removed"), F.count_if(F.col("_n").isNull()).alias("invalid")]
    if by is None:
        out = marked.agg(*counters)
    else:
        out = marked.rollup(by).agg(*counters, F.grouping(by).cast("boolean").alias("is_total"))
    return out.withColumn("removed_pct", F.try_divide(F.col("removed") * F.lit(100.0), F.col("rows_in")))


def true_only(rows: DataFrame, verdict: str) -> DataFrame:
    return rows.filter(F.col(verdict))


def json_equals(rows: DataFrame, document: str, path: str, wanted: str | None) -> DataFrame:
    """Rows whose JSON has exactly the wanted text at a path; None wants all rows."""
    return rows if wanted is None else rows.filter(F.get_json_object(document, path) == wanted)


def any_field(rows: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which some column holds the query, letter case aside."""
    return rows.filter(contains_any([F.col(c) for c in columns or rows.columns], query))


def key_equals(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose column, as text, equals the wanted text, letter case aside."""
    return rows.filter(F.lower(F.col(column).cast("string")) == wanted.lower())


def without_name_tags(tags: Column, name: Column) -> Column:
    """The tags that aren't a word of the name, letter case aside."""
    words = F.transform(F.split(name, " "), F.lower)
    return F.filter(tags, lambda t: ~F.array_contains(words, F.lower(t)))


def gradable(rows: DataFrame, truth: Column, skip_numbers: bool = False) -> DataFrame:
    """Rows whose truth isn't a lone mark (nor digit, with ``skip_numbers``); tested as it stands, before trimming."""
    skipped = ["-", "'", *(string.digits if skip_numbers else "")]
    return rows.filter(~truth.isin(*skipped))


def finite(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a number: neither null nor NaN nor infinite."""
    v = F.col(value)
    return rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))


def named_files(rows: DataFrame, path: str, pattern: str | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Files whose name matches a pattern and whose extension is one of those given, letter case aside."""
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    kept = rows.filter(name.rlike(pattern.lower())) if pattern else rows
    return kept.filter(F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else kept


def last_step(rows: DataFrame, group: list[str], step: str) -> DataFrame:
    """The row of the highest step of each group; of equal steps any one."""
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(step)))
    return rows.withColumn("_k", best).filter("_k = 1").drop("_k")


def blank_free(text: Column) -> Column:
    """Whether anything but white space is in a text."""
    return without_space(text) != ""
