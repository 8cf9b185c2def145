from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.llm import families

ROWS = "font_family_dir_name string, filename string, node string, split string"


def frame(spark, pairs):
    return spark.createDataFrame([(*p, "x", "y") for p in pairs], ROWS)


def test_keys(spark):
    names = ["ofl/Fam Name", "fam-name ", "FAM_NAME/", "bundles\\x\\famname", "  ", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(families.directory_key(F.col("x"))).collect()]
    assert got == ["famname"] * 4 + [None, None]
    files = ["Fam-Bold.ttf", "fam bold (2).TTF", "FAM_BOLD.otf (1)", "Fam-Bold (1) (2).woff2", ".ttf", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in files], "x string").select(families.file_key(F.col("x"))).collect()]
    assert got == ["fambold"] * 4 + [None, None]


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=30))
def test_roots(spark, pairs):
    edges = [(max(e), min(e)) for e in pairs]
    got = {r.node: r.root for r in families.roots_of(spark.createDataFrame(edges, "a int, b int").distinct()).collect()}
    assert got == union_find(edges)


def test_long_chain_and_hub(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(300)], "a int, b int")
    assert {r.root for r in families.roots_of(chain).collect()} == {0}
    rows = frame(spark, [(f"f{k:04d}", "Same.ttf") for k in range(500)])
    assert families.components(families.ties(rows)).select("root").distinct().count() == 1


def test_splits_over_batches(spark, tmp_path):
    splits = families.FamilySplits(spark, f"file://{tmp_path}", {"train": 0.5, "test": 0.5})
    splits.ingest(frame(spark, [("a", "A.ttf"), ("A ", "A2.ttf"), ("b", "B.ttf"), (None, "A.ttf"), ("c", None)]))
    first = {r.family: r.split for r in splits.families().collect()}
    assert first["a"] == first["A "] and set(first) == {"a", "A ", "b", "c"} and None not in first.values()
    splits.ingest(frame(spark, [("d", "a.TTF"), ("e", "E.ttf"), ("e", "E.ttf")]))
    second = {r.family: r.split for r in splits.families().collect()}
    assert {k: second[k] for k in first} == first and second["d"] == first["a"]
    other = next(f for f in ("b", "c", "e") if second[f] != second["a"])
    splits.ingest(frame(spark, [(other, "A.ttf")]))
    third = {r.family: r.split for r in splits.families().collect()}
    assert {third["a"], third["A "], third["d"], third[other]} == {families.QUARANTINE}
    assigned = splits.assign(frame(spark, [("a", "x"), (None, "x"), ("new", "x")])).collect()
    assert [r.split for r in assigned].count(None) == 2


def test_shares_are_met(spark, tmp_path):
    splits = families.FamilySplits(spark, f"file://{tmp_path}")
    rows = frame(spark, [(f"fam{k}", f"F{k}-{j}.ttf") for k in range(200) for j in range(1 + k % 3)] + [("big", f"Big{j}.ttf") for j in range(40)])
    splits.ingest(rows)
    sizes = {r.split: r.n for r in splits.assign(rows).groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = rows.count()
    assert all(abs(sizes[s] - share * total) <= 0.02 * total for s, share in {"train": 0.8, "validation": 0.1, "test": 0.1}.items())
    pairs = families.family_pairs(splits.families().select("family", "root"))
    assert pairs.count() == 0


def test_no_rows(spark, tmp_path):
    splits = families.FamilySplits(spark, f"file://{tmp_path}")
    splits.ingest(frame(spark, []))
    assert splits.families().count() == 0


@pytest.mark.parametrize("step", ["written", "children", "_put"])
def test_a_batch_that_stops_and_comes_again(spark, tmp_path, monkeypatch, step):
    from inkfold import store

    splits = families.FamilySplits(spark, f"file://{tmp_path}", {"train": 0.5, "test": 0.5})
    first, second = frame(spark, [("a", "A.ttf"), ("b", "B.ttf"), ("c", "C.ttf"), ("c", "C2.ttf")]), frame(spark, [("d", "A.ttf"), ("e", "C.ttf"), ("e", "C.ttf")])
    splits.ingest(first, name="1")

    def stop(*_):
        raise OSError("stopped")

    before = sorted(splits.families().collect())
    with monkeypatch.context() as m:
        m.setattr(store, step, stop)
        with pytest.raises(OSError):
            splits.ingest(second, name="2")
    assert sorted(splits.families().collect()) == before
    for _ in range(2):
        splits.ingest(first, name="1")
        splits.ingest(second, name="2")
    after = {r.family: (r.root, r.split) for r in splits.families().collect()}
    assert after["d"] == after["a"] and after["e"] == after["c"] and len(after) == 5
    weights = {r.root: r.weight for r in splits.state.read("components").collect()}
    assert weights == {"a": 2, "b": 1, "c": 3} and sum(r.weight for r in splits.state.read("totals").collect()) == 6


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=6), min_size=2, max_size=4))
def test_batches_give_the_components_of_all(spark, tmp_path_factory, batches):
    splits = families.FamilySplits(spark, f"file://{tmp_path_factory.mktemp('f')}", {"train": 0.6, "test": 0.4})
    kept: dict = {}
    for batch in batches:
        splits.ingest(frame(spark, [(f"fam{chr(97 + a)}", f"file{b}x.ttf") for a, b in batch]))
        now = {r.family: r.split for r in splits.families().collect()}
        assert all(now[f] in (kept[f], families.QUARANTINE) for f in kept)
        kept = now
    every = [(f"fam{chr(97 + a)}", f"f{b}") for batch in batches for a, b in batch]
    roots = union_find([(f, k) for f, k in every])
    groups = lambda of: {frozenset(f for f in of if of[f] == r) for r in set(of.values())}
    got = {r.family: r.root for r in splits.families().collect()}
    assert groups(got) == groups({f: roots[f] for f, _ in every})
    assert {r.root for r in splits.state.read("components").collect()} == set(got.values())
