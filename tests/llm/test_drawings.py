"""Near copies of drawings and overlaps across splits, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from inkfold.llm import drawing, nearcopy, overlap


def multiset(text: str | None) -> Counter:
    out: Counter = Counter()
    for d in drawing.path_data(text):
        for m in re.finditer(r"([A-DF-Za-df-z])([^A-DF-Za-df-z]*)", d):
            out[m[1], tuple(float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", m[2]))] += 1
    return out


def alike(a: Counter, b: Counter) -> bool:
    n = max(a.total(), b.total())
    return bool(n) and (a & b).total() >= math.ceil(0.75 * n)


def drawn(rng, n, wide=400):
    return [rng.choice("lqhvcz") for _ in range(n)], [[rng.randint(-wide, wide) for _ in range(6)] for _ in range(n)]


def spelled(rng, letters, numbers):
    take = {"l": 2, "q": 4, "h": 1, "v": 1, "c": 6, "z": 0}
    forms = [str, lambda x: f"{x}.0", lambda x: f"{x:+d}", lambda x: f"{x}e0", lambda x: f"0{x}" if x >= 0 else str(x)]
    body = "".join(c + " ".join(rng.choice(forms)(x) for x in v[: take[c]]) for c, v in zip(letters, numbers))
    return f"<path fill='x' d='M1 1{body}'/>" if rng.random() < 0.5 else f'<path d="M 1,1 {body}"/>'


def corpus(seed, groups=12, wide=400):
    rng = random.Random(seed)
    texts = [None, "", "<svg></svg>", '<path d=""/>', '<path d="M0 0"/>', '<path d="M0 0"/>', '<path d="M0,0z']
    for _ in range(groups):
        letters, numbers = drawn(rng, rng.randint(1, 30), wide)
        for _ in range(4):
            order = list(range(len(letters)))
            rng.shuffle(order)
            ls, ns = [letters[k] for k in order], [list(numbers[k]) for k in order]
            for k in range(len(ls)):
                if rng.random() < 0.12:
                    ns[k][0] += 1
            if rng.random() < 0.3 and len(ls) > 2:
                del ls[0], ns[0]
            texts.append(spelled(rng, ls, ns))
    return texts


def test_tokens_are_multisets():
    same = ['<path d="M16 795q54 123 146-46h-116.4z"/>', "<path d='M 16,795.0 q 54 1.23e2 +146 -46 h -116.40 z'>", '<path d="h-116.4M16 795z"/>\n<PATH x="1" d="q54 123 146-46']
    offsets, tokens = drawing.tokens_of([*same, None, "", '<path d="l-0 5"/>', '<path d="l0 05"/>', '<path id="M1 1" data-d="M2 2" d="l.5.5"/>', '<path d="l0.5 0.5"/>'])
    sets = [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 4 and sets[3] == sets[4] == []
    assert sets[5] == sets[6] and sets[7] == sets[8]
    a, b = corpus(1), drawing.tokens_of(corpus(1))
    assert [int(n) for n in b[0][1:] - b[0][:-1]] == [multiset(t).total() for t in a]


@pytest.mark.parametrize("seed, wide, long_list, widest", [(1, 400, 1000, 64), (2, 2, 1000, 64), (3, 2, 4, 64), (4, 2, 1, 5), (2, 3, 0, 8)])
def test_near_copies_against_brute_force(spark, seed, wide, long_list, widest):
    texts = corpus(seed, wide=wide)
    rows = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(texts)], "i bigint, t string, tokens string, n int")
    members, links = nearcopy.near_copies(rows, "i", "t", long_list=long_list, widest=widest)
    got = {tuple(r) for r in nearcopy.expanded(members, links).collect()}
    sets = [multiset(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(sets[a], sets[b])}
    assert got == want and want
    grouped = nearcopy.grouped(members, links).collect()
    assert len(grouped) == sum(bool(s) for s in sets)


def test_no_rows_and_bad_share(spark):
    empty = spark.createDataFrame([], "i bigint, t string")
    members, links = nearcopy.near_copies(empty, "i", "t")
    assert nearcopy.expanded(members, links).count() == 0
    with pytest.raises(ValueError):
        nearcopy.near_copies(empty, "i", "t", share=0)


def test_very_long_drawing(spark):
    long_ = '<path d="M0 0' + "".join(f"l{k} {k % 977}" for k in range(60_000)) + '"/>'
    rows = spark.createDataFrame([(1, long_), (2, long_[:-40_000] + '"/>'), (3, long_ + long_)], "i bigint, t string")
    members, links = nearcopy.near_copies(rows, "i", "t")
    assert {tuple(r) for r in nearcopy.expanded(members, links).collect()} == {(1, 2)}


def test_one_command_very_often(spark):
    path = lambda often, rest: '<path d="M0 0' + "l1 2" * often + "".join(f"l{k} 7" for k in range(rest)) + '"/>'
    texts = [path(100_000, 0), path(99_000, 1_000), path(80_000, 0), path(70_000, 0)]
    offsets, tokens = drawing.tokens_of(texts)
    assert all(len(set(tokens[a:b].tolist())) == b - a and (tokens[a:b][1:] > tokens[a:b][:-1]).all() for a, b in zip(offsets, offsets[1:]))
    rows = spark.createDataFrame([(k, "dev" if k % 2 else "train", "Text to draw: a", t) for k, t in enumerate(texts)], "i bigint, split string, ask string, t string")
    sets = [multiset(t) for t in texts]
    want = {(a, b) for a in range(4) for b in range(a + 1, 4) if alike(sets[a], sets[b])}
    members, links = nearcopy.near_copies(rows, "i", "t")
    assert {tuple(r) for r in nearcopy.expanded(members, links).collect()} == want == {(0, 1), (0, 2), (1, 2), (2, 3)}
    members, links = overlap.cross_split(rows, "i", "split", "ask", "t")
    assert {tuple(sorted(r)) for r in overlap.cross_pairs(members, links).collect()} == {(a, b) for a, b in want if a % 2 != b % 2}


@pytest.mark.parametrize("seed", [5, 6])
def test_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed, groups=25)
    asks = ["Style wanted: x\n\nText to draw: a<|SEP|>b\n", "TEXT TO DRAW:  ab ", "Text to draw: aB", "nothing", None]
    rows = [(k, rng.choice(["train", "train", "dev", "ood_test", None]), rng.choice(asks), t, '{"source": "s"}') for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i bigint, split string, ask string, t string, m string")
    members, links = overlap.cross_split(frame, "i", "split", "ask", "t")
    got = {tuple(r) for r in overlap.cross_pairs(members, links).collect()}
    text = lambda a: a[a.lower().index("draw:") + 5 :].replace("<|SEP|>", "").strip() if a and "draw:" in a.lower() else None
    sets = [multiset(t) for t in texts]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] != "train" and b[1] == "train" and text(a[2]) is not None and text(a[2]) == text(b[2]) and alike(sets[a[0]], sets[b[0]])}
    assert got == want and want
    told = overlap.report(frame, "i", "split", "m", members, links).collect()
    assert sum(r.repeated for r in told) == len({a for a, _ in want})
    assert sum(r.records for r in told) == sum(r[1] not in ("train", None) for r in rows)


@pytest.mark.parametrize("long_list, widest", [(1000, 64), (1, 64), (0, 7)])
@pytest.mark.parametrize("changed", ["full", "short"])
def test_overlaps_of_mostly_short_commands(spark, changed, long_list, widest):
    """Drawings of which 20 to 100 % are commands of fewer than two numbers, a quarter of all changed, all among the one kind if possible."""
    rng = random.Random(f"{changed}")
    rows = []
    for percent in range(20, 101, 8):
        for _ in range(3):
            n = rng.choice([8, 20, 40])
            short = round(n * percent / 100)
            commands = [rng.choice(["z", f"h{rng.randint(1, 99)}", f"v{rng.randint(1, 99)}"]) for _ in range(short)] + [f"l{rng.randint(1, 999)} {rng.randint(1, 999)}" for _ in range(n - short)]
            other, spots = list(commands), range(n)[::-1] if changed == "full" else range(n)
            for k in spots[: n // 4]:
                other[k] = f"l{rng.randint(1000, 1999)} 1" if k >= short else f"h{rng.randint(1000, 1999)}"
            for split, body in (("dev", commands), ("train", other), ("train", other[: n - n // 4 - 1])):
                rows.append((len(rows), split, f"Text to draw: {percent // 40}", '<path d="' + "".join(rng.sample(body, len(body))) + '"/>'))
    members, links = overlap.cross_split(spark.createDataFrame(rows, "i bigint, split string, ask string, t string"), "i", "split", "ask", "t", long_list=long_list, widest=widest)
    got = {tuple(r) for r in overlap.cross_pairs(members, links).collect()}
    sets = [multiset(r[3]) for r in rows]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "dev" and b[1] == "train" and a[2] == b[2] and alike(sets[a[0]], sets[b[0]])}
    assert len(want) >= 33 and got == want


def both_ways(spark, texts):
    """Pairs that the two operators find among texts of which every second one is in train, all asking for one text."""
    rows = spark.createDataFrame([(k, "dev" if k % 2 else "train", "Text to draw: a", t) for k, t in enumerate(texts)], "i bigint, split string, ask string, t string")
    near = {tuple(r) for r in nearcopy.expanded(*nearcopy.near_copies(rows, "i", "t")).collect()}
    cross = {tuple(sorted(r)) for r in overlap.cross_pairs(*overlap.cross_split(rows, "i", "split", "ask", "t")).collect()}
    assert cross == {(a, b) for a, b in near if a % 2 != b % 2}
    return near


def test_numbers_are_exact(spark):
    base = "".join(f"l{k} {k + 1}" for k in range(3))
    of = lambda *xs: '<path d="' + base + "".join(f"h{x}" for x in xs) + '"/>'
    apart = [of(".00000012", ".00000012"), of(".00000034", ".00000034"), of("1234567890123", "98765432109876"), of("1234567890124", "98765432109877"), of("-1e20", "3e-30"), of("1e20", "-3e-30")]
    same = [of("0.00000012", "12e-8"), of("1.2e-7", "+.000000120"), of("123456789012.5e1", "1e-30"), of("1234567890125.0", "0.001e-27")]
    assert both_ways(spark, apart + same) == {(0, 6), (0, 7), (6, 7), (8, 9)}
    assert drawing.tokens_of([of("-0", "0.0")])[1].tolist() == drawing.tokens_of([of("0", "-.0e5")])[1].tolist()


def test_arc_flags_without_blanks(spark):
    texts = ['<path d="M0 0a5 5 0 0110 10z"/>', '<path d="M0 0a5 5 0 0 1 10 10z"/>', '<path d="M0,0a5,5,0,01,10,10z"/>', '<path d="M0 0a5 5 0 0010 10z"/>', '<path d="M0 0A5.5.5-3 1 0-1e1-2 7 7 0 0110 10z"/>', '<path d="M0 0A5.5 0.5 -3 10-10-2 7 7 0 0 1 10 10z"/>']
    assert both_ways(spark, texts) == {(0, 1), (0, 2), (1, 2), (4, 5)}


@pytest.mark.parametrize("letters", ["hv", "hvz", "qc", "lqhvcz"])
def test_nothing_is_lost_at_any_overlap(spark, letters):
    """Drawings of one kind of outline that share 70 to 95 % of their commands, of 4 to 400 commands; recall must be 1."""
    rng = random.Random(letters)
    take = {"l": 2, "q": 4, "h": 1, "v": 1, "c": 6, "z": 0}
    command = lambda wide: (c := rng.choice(letters)) + " ".join(str(rng.randint(0, wide)) for _ in range(take[c]))
    texts = []
    for n in (4, 7, 19, 40, 75, 130, 158, 200, 400):
        for kept in (0.7, 0.75, 0.76, 0.8, 0.85, 0.9, 0.95):
            base = [command(300) for _ in range(n)]
            other = base[: math.ceil(n * kept)] + [command(9999) for _ in range(n - math.ceil(n * kept))]
            if rng.random() < 0.5:
                other = other[: math.ceil(n * kept)]
            for commands in (base, other):
                rng.shuffle(commands)
                texts.append('<path d="' + "".join(commands) + '"/>')
    sets = [multiset(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(sets[a], sets[b])}
    assert both_ways(spark, texts) == want and len(want) >= 50
