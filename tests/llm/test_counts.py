"""Cutoffs per source and term counts, in one batch and in several."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.llm import cutoffs, terms

RECORDS = "key string, source string, score bigint, version bigint"


def brute(records, fraction):
    out = {}
    for s in {r[1] for r in records}:
        scores = sorted(r[2] for r in records if r[1] == s)
        cut = scores[math.ceil(round(fraction * len(scores), 9)) - 1]
        out[s] = (cut, sum(x <= cut for x in scores))
    return out


def found(tree, fraction=0.9):
    return {r.source: (r.cutoff, r.kept) for r in tree.cutoffs(fraction).collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.integers(-5, 5), st.integers(-(2**62), 2**62))), min_size=1, max_size=40), st.sampled_from([0.1, 0.5, 0.9, 1.0]))
def test_cutoffs_against_brute_force(spark, tmp_path_factory, pairs, fraction):
    records = [(str(k), s, v, 0) for k, (s, v) in enumerate(pairs)]
    tree = cutoffs.SourceCutoffs(spark, f"file://{tmp_path_factory.mktemp('c')}")
    tree.ingest(spark.createDataFrame(records, RECORDS))
    assert found(tree, fraction) == brute(records, fraction)


def test_cutoffs_follow_changes(spark, tmp_path):
    tree = cutoffs.SourceCutoffs(spark, f"file://{tmp_path}")
    tree.ingest(spark.createDataFrame([("a", "s", 10, 1), ("b", "s", 20, 1), ("c", "t", 5, 1), ("x", None, 1, 1), (None, "s", 1, 1), ("n", "s", None, 1)], RECORDS))
    tree.ingest(spark.createDataFrame([("a", "s", 40, 2), ("b", "s", 1, 0), ("c", "u", 5, None), ("d", "s", 30, None), ("d", "s", 30, None)], RECORDS))
    assert found(tree, 0.5) == brute([("a", "s", 40), ("b", "s", 20), ("d", "s", 30), ("c", "t", 5)], 0.5)
    tree.ingest(spark.createDataFrame([("c", "u", 7, 3)], RECORDS), gone=spark.createDataFrame([("a",)], "key string"))
    tree.compact()
    assert found(tree, 0.9) == {"s": (30, 2), "u": (7, 1)}
    with pytest.raises(ValueError):
        tree.cutoffs(0)


def test_kept_records(spark):
    rows = spark.createDataFrame([("s", k, k) for k in range(10)] + [(None, 1, 1), ("s", None, 1)], "source string, score int, cutoff int")
    assert sorted(r.score for r in cutoffs.keep_fraction(rows, 0.5).collect()) == [0, 1, 2, 3, 4]
    assert cutoffs.keep_fraction(rows.limit(0)).count() == 0


METADATA = [
    '{"tags": ["A_b", " a-B ", "", null, "c"], "category": "[\\"X\\", \\"x\\"]", "content_str": "a<|SEP|>b"}',
    '{"tags": "lone one", "category": null, "content_str": "ab"}',
    '{"tags": "[not json", "category": []}',
    '{"tags": ["c"], "category"',
    "", None, "[1]", "7",
]


def test_terms_of_metadata(spark):
    rows = spark.createDataFrame([(m, 1) for m in METADATA], "metadata string, terms int")
    got = sorted(sorted((t.field, t.term) for t in r.terms) for r in terms.metadata_terms(rows).collect())
    assert got == sorted(
        [
            sorted([("tags", "a-b"), ("tags", "a-b"), ("tags", "c"), ("category", "x"), ("category", "x"), ("content_str", "ab")]),
            sorted([("tags", "lone-one"), ("content_str", "ab")]),
            [("tags", "[not-json")],
        ]
    )


def test_term_counts_with_deltas(spark, tmp_path):
    frame = lambda *records: spark.createDataFrame([([("tags", t) for t in r],) for r in records], "terms array<struct<field: string, term: string>>")
    counts = terms.TermCounts(spark, f"file://{tmp_path}")
    counts.update(added=frame("aab", "a", "c", ""))
    counts.update(added=frame("b"), removed=frame("a", "c"))
    counts.update()
    state = lambda: {r.term: (r.occurrences, r.records) for r in counts.counts().collect()}
    assert state() == {"a": (2, 1), "b": (2, 2)}
    assert [tuple(r) for r in counts.state.read("counts").groupBy("field", "term").count().filter("count > 1").collect()] == []
    marks = {r.term: r.mark for r in counts.marked(rare=1, common=0.5).collect()}
    assert marks == {"a": "rare", "b": "common"}
    empty = terms.TermCounts(spark, f"file://{tmp_path}/none")
    empty.update(added=frame())
    assert empty.marked().filter(F.col("mark").isNotNull()).count() == 0


def stopping(monkeypatch, name):
    """Make one step of the store fail, as if the driver were lost there."""
    from inkfold import store

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(store, name, stop)


@pytest.mark.parametrize("step", ["written", "children", "_put"])
def test_batches_that_stop_and_come_again(spark, tmp_path, monkeypatch, step):
    frame = lambda *records: spark.createDataFrame([([("tags", t) for t in r],) for r in records], "terms array<struct<field: string, term: string>>")
    counts = terms.TermCounts(spark, f"file://{tmp_path}/t")
    tree = cutoffs.SourceCutoffs(spark, f"file://{tmp_path}/c")
    records = lambda *rows: spark.createDataFrame(list(rows), RECORDS)
    first = records(("a", "s", 10, 1), ("b", "s", 20, 1), ("c", "t", 5, 1))
    counts.update(added=frame("ab", "a"), batch="1")
    tree.ingest(first, name="1")
    second = records(("a", "s", 40, 2), ("d", "s", 30, 1), ("c", "u", 5, 2))
    with monkeypatch.context() as m:
        stopping(m, step)
        with pytest.raises(OSError):
            counts.update(added=frame("b"), removed=frame("a"), batch="2")
        with pytest.raises(OSError):
            tree.ingest(second, name="2")
    assert found(tree, 1.0) == {"s": (20, 2), "t": (5, 1)}
    for _ in range(2):
        counts.update(added=frame("ab", "a"), batch="1")
        counts.update(added=frame("b"), removed=frame("a"), batch="2")
        tree.ingest(first, name="1")
        tree.ingest(second, name="2")
    assert {r.term: (r.occurrences, r.records) for r in counts.counts().collect()} == {"a": (1, 1), "b": (2, 2)}
    assert found(tree, 1.0) == {"s": (40, 3), "u": (5, 1)}
    assert counts.marked(rare=1, common=0.5).count() == 2


def test_a_small_batch_writes_little(spark, tmp_path):
    tree = cutoffs.SourceCutoffs(spark, f"file://{tmp_path}")
    tree.ingest(spark.createDataFrame([(f"k{k}", f"s{k % 3}", k, 1) for k in range(2000)], RECORDS))
    tree.ingest(spark.createDataFrame([("k7", "s1", 3000, 2), ("k8", "s2", 8, 2), ("new", "s0", 1, 1)], RECORDS))
    log = tree.state.read("records")
    assert log.filter("change = 2").count() == 3 and log.count() == 2003
    assert found(tree, 1.0) == {"s0": (1998, 668), "s1": (3000, 667), "s2": (1997, 666)}
    tree.compact()
    assert tree.state.read("records").count() == 2001 and found(tree, 1.0)["s1"] == (3000, 667)
