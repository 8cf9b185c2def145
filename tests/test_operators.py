"""Operators on small fixtures: the cases in which implementations tend to differ."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.metrics import clouds, ocr, pixels, registry, vectors
from inkfold.operators import aggregates, dedup, filters, joins, sampling, sets, skew, splits, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_quantile_filter_counts_zeros(spark):
    rows = frame(spark, [(0,), (0,), (1,), (2,), (10,)], "n int")
    assert tuples(filters.below_quantile(rows, "n", 0.75), "n") == [(1,)]
    assert tuples(filters.below_quantile(frame(spark, [], "n int"), "n")) == []


def test_special_names(spark):
    rows = frame(spark, [("a/Barcode-39.ttf",), ("block/Plain.ttf",), ("x/Sans.ttf",)], "p string")
    assert tuples(rows.select(filters.name_holds_any(F.col("p")))) == [(True,), (False,), (False,)]


def test_length_report_rolls_up(spark):
    rows = frame(spark, [("a", 1), ("a", 9), ("b", None), (None, 1)], "s string, n int")
    got = {(r.s, r.is_total): (r.rows_in, r.rows_out, r.removed, r.invalid) for r in filters.length_report(rows, F.col("n"), 5, "s").collect()}
    assert got == {("a", False): (2, 1, 1, 0), ("b", False): (1, 0, 0, 1), (None, False): (1, 1, 0, 0), (None, True): (4, 2, 1, 1)}


def test_finite_and_gradable(spark):
    rows = frame(spark, [(1.0,), (math.inf,), (math.nan,), (None,)], "v double")
    assert tuples(filters.finite(rows, "v")) == [(1.0,)]
    marks = frame(spark, [("-",), ("'",), ("7",), (" -",)], "t string")
    assert len(tuples(filters.gradable(marks, F.col("t")))) == 2
    assert tuples(filters.gradable(marks, F.col("t"), skip_numbers=True)) == [(" -",)]


def test_overlay_keeps_null_of_files(spark):
    files = frame(spark, [(1, None), (2, "x"), (3, "y")], "k int, v string")
    parents = frame(spark, [(1, "p", "q"), (2, "x", "r")], "k int, v string, w string")
    joined, wrong = joins.overlaid(files, parents, "k")
    assert tuples(joined, "k") == [(1, None, "q"), (2, "x", "r"), (3, "y", None)]
    assert tuples(wrong) == [(1,)]
    with pytest.raises(Exception, match="duplicate key"):
        joins.overlaid(files, parents.union(parents), "k")[0].collect()


def test_alignment_raises(spark):
    a, b = frame(spark, [(1, "a")], "k int, x string"), frame(spark, [(1, "b"), (2, "c")], "k int, y string")
    assert tuples(joins.aligned(a, b.filter("k = 1"), "k")) == [(1, "a", "b")]
    with pytest.raises(Exception, match="one side only"):
        joins.aligned(a, b, "k").collect()
    with pytest.raises(Exception, match="differ in length"):
        joins.zipped(a, b, index="k").collect()


def test_decontamination_of_empty_content(spark):
    cand, ref = frame(spark, [("",), ("a",), ("a",), ("b",), (None,)], "c string"), frame(spark, [("",), ("b",)], "c string")
    key = F.col("c")
    assert sorted(tuples(joins.decontaminated(cand, ref, key, key)), key=str) == [("a",), ("a",), (None,)]
    assert len(tuples(joins.decontaminated(cand, ref, key, key, "keep"))) == 4


def test_passages_of_any_length(spark):
    rows = frame(spark, [(1, "one two three four five six seven eight nine ten"), (2, "tiny note"), (3, None), (4, "other")], "i int, t string")
    passages = frame(spark, [("three four five six seven eight nine ten",), ("tiny",), ("",), (None,), ("tiny",)], "p string")
    assert sorted(r.i for r in joins.holding_passage(rows, "t", passages, "p").collect()) == [1, 2]


def test_last_verdict_wins(spark):
    rows = frame(spark, [("a",), ("b",)], "k string")
    verdicts = frame(spark, [("a", True, 1), ("a", False, 2), ("z", True, 1)], "id string, ok boolean, at int")
    kept, unknown = joins.graded_join(rows, verdicts, "k", F.col("id"), "ok", [F.col("at")])
    assert tuples(kept) == [("a", False)] and tuples(unknown) == [("z",)]


def test_unnest_drops_unsound_families(spark):
    rows = frame(spark, [("A", "s", [("A", "f1"), (None, "f2")]), ("B", "s", [("X", "f3")]), ("C", "s", [("C", "f4")]), ("C", "t", [("C", "f5")])], "name string, stroke string, fonts array<struct<name: string, filename: string>>")
    assert tuples(joins.unnested(rows, "fonts", "name"), "filename") == [("A", "s", "f1"), ("A", "s", "f2")]


def test_differences(spark):
    a, b = frame(spark, [(1, "x"), (2, None), (3, "z")], "k int, v string"), frame(spark, [(1, "x"), (2, None), (4, "w")], "k int, v string")
    assert tuples(joins.differences(a, b, ["k"], ["v"]), "k") == [(3, "left only"), (4, "right only")]


@pytest.mark.parametrize("limit", [1, 100])
def test_key_filter_is_the_same_either_way(spark, limit):
    big, keys = frame(spark, [(k % 5, k) for k in range(20)], "k int, v int"), frame(spark, [(1,), (3,)], "k int")
    assert skew.filtered_by(big, keys, "k", limit=limit).count() == 8
    assert skew.filtered_by(big, keys, "k", present=False, limit=limit).count() == 12


def test_salted_join_and_ranks(spark):
    big = frame(spark, [("hot" if k % 3 else f"k{k}", k) for k in range(60)], "k string, v int")
    small = big.select("k").distinct().withColumn("w", F.length("k"))
    assert skew.salted_join(big, small, "k", F.col("v")).count() == 60
    ranked = skew.dense_rank_by(big, "k", [F.col("v")], cells=4)
    assert sorted(r["rank"] for r in ranked.filter("k = 'hot'").collect()) == list(range(40))


def test_numbering_is_total(spark):
    rows = frame(spark, [(k * 7 % 101,) for k in range(101)], "v int").repartition(5)
    got = tuples(windows.numbered(rows, [F.col("v")]), "row_idx")
    assert got == [(k, k) for k in range(101)]
    assert windows.numbered(frame(spark, [], "v int"), [F.col("v")]).count() == 0


def test_keep_first_ignores_partitions(spark):
    rows = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, t string")
    for parts in (1, 4):
        assert tuples(dedup.keep_first(rows.repartition(parts), F.col("t"), [F.col("i")]).select("i"), "i") == [(1,), (3,), (5,)]
    once = dedup.keep_first(rows, F.col("t"), [F.col("i")])
    assert tuples(dedup.keep_first(once, F.col("t"), [F.col("i")]), "i") == tuples(once, "i")
    assert tuples(dedup.conflicting_keys(frame(spark, [("k", "a"), ("k", "b"), ("l", "a")], "k string, v string"), "k", "v")) == [("k",)]


def test_frequencies(spark):
    rows = frame(spark, [(["a", "b", "a"], "x"), ([], None), (None, "x")], "t array<string>, s string")
    got = {(r.field, r.value): r.n for r in aggregates.value_frequency(rows, ["t", "s"]).collect()}
    assert got == {("t", "a"): 2, ("t", "b"): 1, ("s", "x"): 2}
    assert tuples(aggregates.tag_words(frame(spark, [("a-b", 2), ("c", 3)], "value string, n int")), "word") == [("a", 2), ("a-b", 2), ("b", 2), ("c", 6)]
    assert tuples(aggregates.list_sizes(rows, "t"), "num") == [(0, 2), (3, 1)]


def test_histogram_edges(spark):
    rows = frame(spark, [(-1.0,), (0.0,), (4.9,), (5.0,), (10.0,), (11.0,), (None,)], "v double")
    assert [(r.bin, r.n) for r in aggregates.histogram(rows, "v", 0.0, 10.0, 2).orderBy("bin").collect()] == [(0, 1), (1, 2), (2, 2), (3, 1)]


def test_zero_guards(spark):
    empty = frame(spark, [], "s boolean, u struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, l double")
    assert aggregates.accuracy(empty, "s").first().accuracy is None
    assert aggregates.throughput(empty, "u", "l", F.lit(False)).first().tokens_per_sec is None
    assert aggregates.totals(empty, ["l"]).first().l_avg is None


def test_largest_groups(spark):
    rows = frame(spark, [(g,) for g in "aaabbccd"], "g string")
    assert tuples(aggregates.largest_groups(rows, "g", 0.5), "g") == [("a", 3), ("b", 2)]
    assert tuples(aggregates.largest_groups(rows, "g", 0.01)) == [("a", 3)]


def test_log_and_newlines(spark):
    lines = frame(spark, [(0, "kept 5 of 9"), (1, "kept 4 of 5"), (2, "done")], "row_idx bigint, t string")
    assert tuples(aggregates.logged_counts(lines, "t", {"kept": r"kept (\d+)"})) == [("kept", 4)]
    assert tuples(aggregates.newline_counts(frame(spark, [("a b \u0085",), (None,)], "t string"), "t")) == [(2, 0, 1)]


@settings(max_examples=15, deadline=None)
@given(st.integers(4, 12), st.integers(0, 3), st.integers(0, 3), st.integers(0, 10))
def test_splits_never_leak(spark, n, ood, inner, seed):
    groups = frame(spark, [(f"f{k}",) for k in range(n)], "f string")
    drawn = splits.drawn(groups, "f", ood, min(inner, n - ood), min(inner, n - ood), seed=seed)
    assert all(r.n == 0 for r in splits.violations(drawn, "f").collect())
    sizes = {r.split: r.n for r in drawn.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes.get("ood_test", 0) == ood and sizes["train"] == n - ood


def test_split_arguments(spark):
    for bad in ((5, 6, 0, 0, None), (5, 0, 0, 0, 6), (5, 2, 4, 0, None), (5, -1, 0, 0, None)):
        with pytest.raises(ValueError):
            splits.checked(*bad)
    leaking = frame(spark, [("a", "train"), ("a", "ood_test")], "f string, split string")
    with pytest.raises(ValueError, match="leak"):
        splits.assert_sound(leaking, "f")


def test_group_samples(spark):
    rows, members = frame(spark, [("r1", "g"), ("r2", "h")], "r string, g string"), frame(spark, [("g", m) for m in ("r1", "m2", "m3")], "g string, m string")
    got = {r.r: r.refs for r in sampling.group_samples(rows, members, "g", "r", "m", low=3, high=3).collect()}
    assert sorted(got["r1"]) == ["m2", "m3", "r1"] and got["r2"] == []
    assert sorted(sampling.group_samples(rows, members, "g", "r", "m", low=3, high=3, exclude_self=True).filter("r = 'r1'").first().refs) == ["m2", "m3"]


def test_positions_keep_repeats(spark):
    rows, wanted = frame(spark, [(k, f"v{k}") for k in range(4)], "row_idx int, v string"), frame(spark, [(2,), (2,), (9,)], "at int")
    assert tuples(sampling.by_positions(rows, "row_idx", wanted, "at")) == [(2, "v2"), (2, "v2")]


def test_sets(spark):
    a, b = frame(spark, [("x",), ("y",), ("y",)], "w string"), frame(spark, [("y",), ("z",), ("z",)], "w string")
    assert tuples(sets.both_ways(a, b, "w"), "value") == [("x", "left"), ("z", "right")]
    assert sets.mixed(a, b, 5).count() == 18 and sets.repeated(a, 0).count() == 0
    assert sets.equal_as_sets(a, a, "w") and not sets.equal_as_sets(a, b, "w")
    with pytest.raises(KeyError):
        sets.joined_by_split([{"train": a, "dev": a}, {"train": b}])
    accented = {r.content for r in sets.accented_contents(spark).collect()}
    assert len(accented) == 178 and set("éØøĐđĦħıĸŁłŦŧƑƒŉĿ") <= accented and not accented & set("æßĳſ×÷a")


def test_grading(spark):
    rows = frame(spark, [(" Y e s ", "yes "), ("No", "no"), (None, "a"), ("a<|SEP|>b", "ab")], "p string, t string")
    strict = [r.score for r in ocr.graded(rows, "p", F.col("t")).collect()]
    loose = [r.score for r in ocr.graded(rows, "p", F.col("t"), use_case=False, remove_space=True).collect()]
    assert strict == [False, False, None, True] and loose == [True, True, None, True]
    spaced = frame(spark, [("ab", "a b")], "p string, t string")
    assert not ocr.graded(spaced, "p", F.col("t"), remove_space=True).first().score


def test_metrics_of_equal_inputs_are_best(spark):
    same = frame(spark, [([0.1, 0.9, 0.4, 0.3], [0.1, 0.9, 0.4, 0.3])], "a array<double>, b array<double>")
    points = lambda c: clouds.as_points(F.col(c))
    r = same.select(pixels.mean_square(F.col("a"), F.col("b")), pixels.signal_to_noise(pixels.mean_square(F.col("a"), F.col("b"))), vectors.rescaled_cosine(F.col("a"), F.col("b")), clouds.chamfer(points("a"), points("b")), pixels.structural_similarity(F.col("a"), F.col("b"), 2, 2), clouds.aligned_chamfer(points("a"), points("b"))).first()
    assert r[0] == 0 and r[1] == math.inf and r[2:] == pytest.approx((1, 0, 1, 0))
    assert frame(spark, [([0.0], [1.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_alignment_undoes_a_shift(spark):
    a = [[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [0.0, 2.0]]
    b = [[x + 0.2, y - 0.1] for x, y in a]
    rows = frame(spark, [(a, b)], "a array<array<double>>, b array<array<double>>")
    assert rows.select(clouds.aligned_chamfer(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0, abs=1e-9)
    assert rows.select(clouds.chamfer(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2 * 0.05)


def test_degenerate_clouds_are_zeros(spark):
    rows = frame(spark, [([[1.0, 1.0], [1.0, 1.0]],), ([[0.0, 0.0], [2.0, 1.0]],), ([[0.0, math.nan], [2.0, 1.0]],)], "p array<array<double>>")
    got = [r[0] for r in rows.select(clouds.normalised(F.col("p"))).collect()]
    assert got == [[[0, 0], [0, 0]], [[-1, -0.5], [1, 0.5]], [[0, 0], [0, 0]]]
    assert rows.select(clouds.normalised(F.col("p"), 3)).first()[0] == [[0, 0]] * 3


def test_frechet(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = frame(spark, [(k % 2, [float(v) for v in x[k]]) for k in range(200)], "g int, v array<double>").repartition(4)
    m = {r.g: r for r in vectors.moments(rows, "v", "g").collect()}
    assert np.allclose(np.reshape(m[0].covariance, (3, 3)), np.cov(x[::2].T)) and np.allclose(m[1].mean, x[1::2].mean(0))
    assert vectors.frechet(x.mean(0), np.cov(x.T), x.mean(0), np.cov(x.T)) == pytest.approx(0, abs=1e-9)
    assert vectors.frechet(np.zeros(2), np.eye(2), np.array([3.0, 4.0]), 4 * np.eye(2)) == pytest.approx(25 + 2)


def test_metric_means_skip_what_is_not_finite(spark):
    rows = frame(spark, [([0.0], [0.0]), ([0.0], [1.0]), (None, [1.0])], "predict_pixels array<double>, label_pixels array<double>")
    out = registry.summed_up(registry.scored(rows, ["psnr", "l2"]), ["psnr", "l2"]).first()
    assert (out.rows, out.psnr_rows, out.l2_rows, out.l2) == (3, 1, 2, 0.5)
    with pytest.raises(ValueError):
        registry.register("l2", pixels.mean_square, "a", "b")


def test_numbers_and_sums_over_many_parts(spark):
    """Rows wide enough, and parts enough, that ranges drawn twice would differ."""
    rows = spark.range(30_000, numPartitions=7).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit("x" * 50).alias("pad"), (F.col("id") % 5).alias("n"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = sorted((r.row_idx, r.k) for r in windows.numbered(rows, [F.col("k")]).collect())
        assert [i for i, _ in got] == list(range(30_000)) and [k for _, k in got] == sorted(k for _, k in got)
        assert windows.numbered(rows, [F.col("k")]).select("row_idx").distinct().count() == 30_000
        summed = sorted((r.k, r.n, r.upto) for r in windows.running(rows, [F.col("k")], F.col("n")).collect())
        total = 0
        for _, n, upto in summed:
            total += n
            assert upto == total
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_products_of_any_list(spark):
    fonts, contents = frame(spark, [("f",), ("g",), (None,)], "f string"), frame(spark, [(f"c{k}",) for k in range(23)] + [(None,), ("c1",)], "c string")
    few, many = tuples(joins.products(fonts, contents)), tuples(joins.products(fonts, contents, contents_limit=4))
    assert sorted(few, key=str) == sorted(many, key=str) and len(many) == 75
    assert tuples(joins.products(fonts, contents.limit(0))) == []


@pytest.mark.parametrize("few", [100_000, 0])
def test_quantiles_of_few_and_many_values(spark, few):
    rows = spark.range(2_000).select((F.col("id") % 2).alias("by"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    at = (0.0, 0.1, 0.5, 0.937, 1.0)
    got = {(r.by, r.q): r.value for r in aggregates.exact_quantiles(rows, F.col("v"), at, few=few).collect()}
    for by in (0, 1):
        known = sorted(k * 37 % 101 for k in range(2_000) if k % 2 == by and k % 7)
        for q in at:
            place = q * (len(known) - 1)
            low = math.floor(place)
            assert got[by, q] == pytest.approx(known[low] + (known[min(low + 1, len(known) - 1)] - known[low]) * (place - low))
    assert aggregates.exact_quantiles(rows.limit(0), F.col("v"), at, few=few).count() == 0
