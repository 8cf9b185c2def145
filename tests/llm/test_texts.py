"""Tokens, containers and look-alikes."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.llm import lookalike, packing, tokens

VOCABULARY = pytest.mark.skipif(not Path(tokens.TOKENIZERS, "byte_bpe_50k.json").exists(), reason="no vocabulary files here")
TEXTS = ["", None, "Hello  world\n\n", "a" * 300, "abcdefghij" * 500, "<|endoftext|> x", "I'll we've IT'S", "été　 ½²Ⅷ", "👩‍🎨🙂", "a\x1cb\x00\u0085 ​", "  \t\r\n ", "漢字かな交じり文", "x" * 3 + "1234567"]


@VOCABULARY
def test_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rows = spark.createDataFrame([(k % 10 if k != 3 else None, t, "w", [1]) for k, t in enumerate(TEXTS)], "i int, t string, word string, ids array<int>")
    out = tokens.decode(tokens.encode(rows, "i", "t"), "ids", "back").collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert list(r.ids) == (library.encode(r.t, add_special_tokens=False).ids if r.t else [])
        assert r.back == (r.t or "") and r.word == "w"
    assert tokens.encode(rows.limit(0), "i", "t").count() == 0


@VOCABULARY
@pytest.mark.parametrize("few", [True, False])
def test_missed_words_of_one_hash(spark, monkeypatch, few):
    """Words that share their number in a text, and codes that are joined by a shuffle."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "BROADCAST_CODES", 10**6 if few else 0)
    plain = F.xxhash64
    monkeypatch.setattr(tokens.F, "xxhash64", lambda *c: plain(*c) if len(c) > 1 else plain(*c) * 0)
    texts = ["kogilbari zarelfato kogilbari", "qwxzk vbnmq hello qwxzk", "plain words", "", None, "vbnmq"]
    got = {r.i: list(r.ids) for r in tokens.encode(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids if t else [] for k, t in enumerate(texts)}


@VOCABULARY
def test_decoding_guards(spark):
    rows = spark.createDataFrame([([99_999_999],), (None,), ([0xA0 + 60],), ([],)], "ids array<int>")
    got = [r.text for r in tokens.decode(rows, "ids").collect()]
    assert got[0] is None and got[1] is None and got[3] == ""


def least_bins(sizes, capacity):
    """Exact, by trying every partition of few items."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted({x: i for i, x in enumerate(bins)}.values()):
            if bins[b] + sizes[k] <= capacity:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_loses_nothing(sizes):
    fixed, rest = packing.reduce_dominated(Counter(sizes), 20)
    used = Counter(s for p, k in fixed for s in p * k)
    assert used + Counter(rest) == Counter(sizes)
    assert all(sum(p) <= 20 for p, _ in fixed)
    left = sorted(Counter(rest).elements(), reverse=True)
    assert sum(k for _, k in fixed) + (least_bins(left, 20) if left else 0) == least_bins(sorted(sizes, reverse=True), 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=20))
def test_plans_hold_every_item(counts):
    made = packing.plan(counts, 64)
    assert Counter({s: sum(p.count(s) * k for p, k in made) for s in counts}) == Counter(counts)
    assert all(sum(p) <= 64 and k > 0 for p, k in made)
    bins: list[int] = []
    for s in sorted(Counter(counts).elements(), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= s), None)
        if k is None:
            bins.append(64 - s)
        else:
            bins[k] -= s
    assert sum(k for _, k in made) <= 1.02 * len(bins) + 1


def test_pack(spark):
    rng = random.Random(4)
    sizes = [rng.choice([7, 50, 50, 99, 100, 250, 305, None, 0, -3]) for _ in range(400)]
    rows = spark.createDataFrame([(k // 2, s, "x", 0) for k, s in enumerate(sizes)], "i int, s int, rank string, part int")
    got = packing.pack(rows, "i", "s", 100).collect()
    assert sum(r.size for r in got) == sum(s for s in sizes if s and s > 0)
    full = Counter()
    for r in got:
        assert (r.container is None) == (r.size == 0) and r.start == 100 * r.part
        full[r.container] += r.size
    del full[None]
    assert max(full.values()) <= 100 and set(full) == set(range(len(full)))
    assert sum(1 for r in got if r.part) == sum((s - 1) // 100 for s in sizes if s and s > 100)
    assert packing.usage(packing.pack(rows, "i", "s", 100), 100).first().containers == len(full)
    assert packing.pack(rows.limit(0), "i", "s").count() == 0
    assert packing.usage(packing.pack(rows.limit(0), "i", "s")).first().unused is None
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 10)


@VOCABULARY
def test_pack_texts(spark):
    rows = spark.createDataFrame([(1, "word " * 5000), (2, None), (3, ""), (4, "hello")], "i int, t string")
    got = sorted((r.i, r.part, r.size) for r in packing.pack_texts(rows, "i", "t").collect())
    assert [g for g in got if g[0] != 1] == [(2, 0, 0), (3, 0, 0), (4, 0, 1)] and {p for i, p, _ in got if i == 1} == {0, 1, 2}


LOOK = {a: b for s, t in lookalike.LOOKALIKES.values() for a, b in zip(s, t, strict=True)}


def plain(text):
    """The consistent form by Python's own tables, one text at a time."""
    if text is None:
        return None
    picture = re.compile(f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in lookalike.PICTURES)}]")
    out, base = [], ""
    for ch in text:
        if ch in lookalike.KEPT_IN_PICTURES and base and picture.match(base):
            out.append(ch)
            continue
        if unicodedata.category(ch)[0] != "M" and not lookalike._within(ord(ch), lookalike.INVISIBLE):
            base = ch
        out.append(lookalike._becomes(ch, LOOK) if ord(ch) > 127 else ch)
    return re.sub("\r\n?", "\n", unicodedata.normalize("NFC", "".join(out)))


def test_consistent_form(spark):
    rng = random.Random(8)
    pool = "aZ1 -\t\nеОοⅷﬁ２Ｑ̛̣́̂​‍️­ 　ｶﾞ각각가👩🎨é漢⼀²K‑;"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "а" * 50_000, "​" * 500, "a\r\nb\rc d"]
    rows = spark.createDataFrame([(k % 250 if k != 7 else None, t, "c", "f") for k, t in enumerate(texts)], "i int, t string, cluster string, form string")
    got = lookalike.consistent(rows, "i", "t").collect()
    assert len(got) == len(texts)
    assert [(r.t, r.consistent) for r in got if r.consistent != plain(r.t)] == []
    again = lookalike.consistent(lookalike.consistent(rows, "i", "t", "u"), "i", "u", "v").filter(~F.col("u").eqNullSafe(F.col("v")))
    assert again.count() == 0
    assert lookalike.consistent(rows.limit(0), "i", "t").count() == 0


def test_what_stays_apart(spark):
    apart = ["Abc", "abc", "ábc", "abc1", "abc2", "abc²", "abcd", "a\tbc", "👩‍🎨", "👩🎨"]
    rows = spark.createDataFrame(list(enumerate(apart)), "i int, t string")
    assert len({r.consistent for r in lookalike.consistent(rows, "i", "t").collect()}) == len(apart)


def test_pairs_of_forms(spark):
    texts = ["a b", "a b", "a b", "а b", None, "", " ", "​", "x", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {tuple(r) for r in lookalike.alike_pairs(lookalike.consistent(rows, "i", "t", "f"), "i", "t", "f").collect()}
    same = [k for k in range(4)]
    assert got == {(a, b) for a, b in itertools.combinations(same, 2) if texts[a] != texts[b]}


@VOCABULARY
def test_very_long_words(spark):
    """Words of many times the window: random, periodic, of one letter, of many bytes a letter, against the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(3)
    letters = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (255, 256, 257, 384, 385, 3000, 20_000)]
    texts += [letters("etaoin", 4000), letters("漢字東京都日本", 900), letters("=-", 2000), "-" * 3001, "ab" * 1500 + "c" * 700, "the" * 900 + "x", letters("0123456789", 1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.ids) for r in tokens.encode(rows, "i", "t").collect()}
    assert [k for k, t in enumerate(texts) if got[k] != library.encode(t, add_special_tokens=False).ids] == []
