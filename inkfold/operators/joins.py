"""Joins by key, digest and position, with what happens to repeated and missing keys said in the call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once_per_key(rows: DataFrame, key: str, on_duplicate: str, order: list[Column] | None = None) -> DataFrame:
    """One row a key. ``on_duplicate``: ``first`` or ``last`` by ``order``, or ``raise``."""
    if on_duplicate == "raise":
        n = F.count("*").over(Window.partitionBy(key))
        checked = rows.withColumn("_n", n)
        ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
        return checked.filter(ok).drop("_n")
    if on_duplicate not in ("first", "last") or not order:
        raise ValueError("on_duplicate must be raise, or first or last with an order")
    turned = [o.desc() for o in order] if on_duplicate == "last" else list(order)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*turned))).filter("_k = 1").drop("_k")


def display_tags(tags: DataFrame, dim: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``(family, ord, tag, weight)`` from raw tags: the display name of the dimension or an override; null where neither knows the tag."""
    names = dim.filter(F.col("raw_tags").isNotNull()).groupBy(F.col("raw_tags").alias("_raw")).agg(F.min("tags").alias("_tag"))
    chosen = F.col("_tag")
    for raw, shown in (overrides or {}).items():
        chosen = F.when(F.col("raw_tags") == raw, F.lit(shown)).otherwise(chosen)
    joined = tags.join(names, F.col("raw_tags") == F.col("_raw"), "left")
    return joined.select(F.col("font_family").alias("family"), "raw_tags", chosen.alias("tag"), F.col("tag_weight").alias("weight"))


def collected_tags(rows: DataFrame, tags: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows with their family's tags and weights as two arrays in the same order; families without a tag row are dropped.

    ``tags``: ``(family, tag, weight)`` and the columns of ``order``; null tags are left out.
    """
    entry = F.struct(*order, "tag", "weight")
    lists = tags.filter(F.col("tag").isNotNull()).groupBy(F.col("family").alias("_family")).agg(F.array_sort(F.collect_list(entry)).alias("_t"))
    joined = rows.join(lists, F.col(name) == F.col("_family"))
    return joined.withColumn("tags", F.col("_t.tag")).withColumn("tag_weights", F.col("_t.weight")).drop("_t", "_family")


def overlaid(files: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(joined, mismatches)``. All file rows, with their parent's columns; where both have a column the file's value wins,
    even a null. ``mismatches``: rows in which a shared column differs, by column; null equals null, rows without a parent don't count.

    A repeated parent key raises.
    """
    own = once_per_key(parents, key, "raise").select(*[F.col(c).alias(f"_p_{c}") for c in parents.columns], F.lit(True).alias("_found"))
    joined = files.join(own, F.col(key) == F.col(f"_p_{key}"), "left")
    shared = [c for c in parents.columns if c in files.columns and c != key]
    added = [F.col(f"_p_{c}").alias(c) for c in parents.columns if c not in files.columns]
    differs = [F.count_if(F.coalesce(F.col("_found"), F.lit(False)) & ~F.col(c).eqNullSafe(F.col(f"_p_{c}"))).alias(c) for c in shared]
    mismatches = joined.agg(*differs) if differs else joined.limit(0).select()
    return joined.select(*files.columns, *added), mismatches


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that both sides have once and both sides have; raises otherwise."""
    a, b = once_per_key(left, key, "raise"), once_per_key(right, key, "raise")
    joined = a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "full")
    both = F.when(F.col(key).isNull() | F.col("_key").isNull(), F.raise_error(F.concat(F.lit("key on one side only: "), F.coalesce(key, "_key").cast("string"))).cast("boolean")).otherwise(True)
    return joined.filter(both).drop("_key")


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with what the table has for their key; rows it doesn't know are dropped. The plan is left to Spark."""
    return rows.join(table, key)


def products(fonts: DataFrame, contents: DataFrame, contents_limit: int = 100_000) -> DataFrame:
    """Every font with every content, which is the result asked for.

    The contents are counted: up to the limit they are sent to all tasks. A longer list is dealt out to parts of half the limit, and each
    font is joined with each part by its number, so that no task holds the list.
    """
    n = contents.count()
    if n <= contents_limit:
        return fonts.crossJoin(F.broadcast(contents))
    parts = -(-2 * n // contents_limit)
    dealt = contents.withColumn("_part", F.pmod(F.xxhash64(*contents.columns), F.lit(parts)).cast("int"))
    return fonts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, "_part").drop("_part")


def decontaminated(candidates: DataFrame, reference: DataFrame, key: Column, reference_key: Column, empty_policy: str = "match") -> DataFrame:
    """Candidates whose content key isn't in the reference. Repeated candidates stay; the result is there even if nothing is dropped.

    Content without any path has the empty key. ``empty_policy``: ``match`` lets an empty reference row drop all empty
    candidates, ``keep`` never drops them. Null keys are never dropped.
    """
    if empty_policy not in ("match", "keep"):
        raise ValueError("empty_policy must be match or keep")
    wanted = F.when(key != "", key) if empty_policy == "keep" else key
    seen = reference.select(reference_key.alias("_seen")).distinct()
    return candidates.withColumn("_k", wanted).join(seen, F.col("_k") == F.col("_seen"), "left_anti").drop("_k")


#: Passages and bytes of theirs that may be sent to all tasks.
PASSAGES, PASSAGE_BYTES = 200_000, 32_000_000


def holding_passage(rows: DataFrame, text: str, passages: DataFrame, passage: str, words: int = 8) -> DataFrame:
    """Rows whose text holds a whole passage, word by word. Rows and passages meet by shared runs of ``words`` words, then the passage
    is looked for in the text; passages of fewer words meet by their own length.

    The passages are counted first: within bounds they go to all tasks and no run of a text is shuffled, beyond them runs meet by a shuffle.
    """
    run = lambda h, i, n: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    runs = lambda h, n: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(0))), lambda _, i: run(h, i, n))
    cut = lambda c: F.transform(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), r"(?U)[^\w]+", " ")), " "), lambda w: F.xxhash64(w))
    asked = passages.filter(F.col(passage) != "").select(F.col(passage).alias("_passage"), cut(passage).alias("_w")).distinct()
    sizes = F.least(F.size("_w"), F.lit(words))
    asked = asked.withColumn("_n", sizes).withColumn("_key", F.coalesce(*[F.when(F.col("_n") == n, run(F.col("_w"), F.lit(0), n)) for n in range(1, words + 1)]))
    known = asked.agg(F.collect_set("_n").alias("lengths"), F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_passage")), F.lit(0)).alias("bytes")).first()  # at most ``words`` lengths
    few = known["n"] <= PASSAGES and known["bytes"] <= PASSAGE_BYTES
    digest = F.sha2(text, 256)
    found = F.array_distinct(F.concat(*[runs(F.col("_w"), n) for n in sorted(known["lengths"])])) if known["lengths"] else F.array().cast("array<bigint>")
    keyed = rows.select(digest.alias("_text"), cut(text).alias("_w")).select("_text", F.explode(found).alias("_key"))  # digests only: a text isn't repeated for its runs
    by_key = asked.groupBy("_key").agg(F.collect_set("_passage").alias("_passages"))
    met = keyed.join(F.broadcast(by_key) if few else by_key.hint("merge"), "_key").select("_text", F.explode("_passages").alias("_passage")).distinct()
    return rows.join(met, (digest == F.col("_text")) & F.contains(F.col(text), F.col("_passage")), "left_semi")


def graded_join(rows: DataFrame, verdicts: DataFrame, key: str, verdict_key: Column, verdict: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(kept, unknown)``: rows with their verdict (the last of several by ``order``; rows without one are dropped), and the
    verdict keys that no row has, which should be none."""
    last = once_per_key(verdicts.withColumn("_vk", verdict_key), "_vk", "last", order)
    kept = rows.join(last.select("_vk", F.col(verdict).alias(f"{verdict}_given")), F.col(key) == F.col("_vk")).drop("_vk")
    return kept, last.join(rows.select(F.col(key).alias("_rk")), F.col("_vk") == F.col("_rk"), "left_anti").select(F.col("_vk").alias(key))


def zipped(*frames: DataFrame, index: str = "row_idx") -> DataFrame:
    """Frames side by side by row number. A row number that one of them lacks raises; other columns must have different names."""
    joined = frames[0]
    for k, frame in enumerate(frames[1:]):
        other = frame.withColumnRenamed(index, f"_i{k}")
        joined = joined.join(other, F.col(index) == F.col(f"_i{k}"), "full")
        whole = F.when(F.col(index).isNull() | F.col(f"_i{k}").isNull(), F.raise_error(F.lit("the inputs differ in length")).cast("boolean")).otherwise(True)
        joined = joined.filter(whole).drop(f"_i{k}")
    return joined


def mismatched(rows: DataFrame, computed: Column, stored: str) -> DataFrame:
    """Rows whose computed digest differs from the stored one."""
    return rows.filter(~computed.eqNullSafe(F.col(stored)))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is among the done ones: an anti-join a key, nulls match nothing."""
    for key in keys:
        seen = done.select(F.col(key).alias("_done")).filter("_done IS NOT NULL").distinct()
        rows = rows.join(seen, F.col(key) == F.col("_done"), "left_anti")
    return rows


def compared_runs(base: DataFrame, runs: list[DataFrame], key: str, value: str, order: list[Column]) -> DataFrame:
    """Base rows with the value of each run as ``value1``, ``value2``, ...; the last of several in a run, null where it has none."""
    for k, run in enumerate(runs, 1):
        last = once_per_key(run, key, "last", order).select(F.col(key).alias("_rk"), F.col(value).alias(f"{value}{k}"))
        base = base.join(last, F.col(key) == F.col("_rk"), "left").drop("_rk")
    return base


def differences(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``(key..., problem)`` of what keeps two datasets from being equal: ``left only``, ``right only``, ``differs``. None: equal."""
    pack = lambda df, side: df.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.struct(*values).alias(f"{side}_v"), F.lit(True).alias(side))
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in key]
    joined = pack(left, "l").join(pack(right, "r"), on, "full")
    problem = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").when(~F.col("l_v").eqNullSafe(F.col("r_v")), "differs")
    return joined.select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in key], problem.alias("problem")).filter("problem IS NOT NULL")


def unnested(families: DataFrame, members: str, name: str) -> DataFrame:
    """One row a member: its own fields over the family's, the name of the family where it has none. Families in which a member's name
    isn't the family's, or that come twice, are dropped as a whole."""
    inner = [f.name for f in families.schema[members].dataType.elementType.fields]
    n = F.count("*").over(Window.partitionBy(name))
    sound = families.withColumn("_n", n).filter("_n = 1").drop("_n")
    if name in inner:
        sound = sound.filter(~F.exists(members, lambda m: m[name].isNotNull() & (m[name] != F.col(name))))
    outer = [c for c in families.columns if c != members and (c not in inner or c == name)]
    return sound.select(*outer, F.explode(members).alias("_m")).select(*outer, *[F.col(f"_m.{c}").alias(c) for c in inner if c != name])


def fanned_out(splits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of each key that a split has."""
    return rows.join(splits, key)
