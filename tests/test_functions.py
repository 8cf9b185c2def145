"""Functions with values worked out by hand."""

from __future__ import annotations

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.functions import hashing, numbers, paths, svg, templates, text, tokenize


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_blake2_values(spark):
    assert values(spark, hashing.blake2_key(F.col("x")), ["x", None]) == ["442a44457137672b", None]
    assert values(spark, hashing.blake2_key(F.col("x"), 32), ["x"]) == ["d161d71145abeec5"]
    assert values(spark, hashing.sha256_key(F.col("x")), ["é"]) == [hashlib.sha256("é".encode()).hexdigest()[:20]]


def test_half_goes_up(spark):
    got = values(spark, numbers.round_half_up(F.col("x")), [-0.5, 0.5, 2.5, -2.5], "x double")
    assert got == [0.0, 1.0, 3.0, -2.0]
    assert values(spark, numbers.round_half_up(F.col("x"), 1), [0.05], "x double") == [0.1]
    assert values(spark, numbers.rounded_text(F.col("x")), ["2.5", "1e-3", "x"]) == ["3", "0", None]


def test_text_functions(spark):
    assert values(spark, text.separated(F.col("x")), ["Yes", "", None]) == ["Y<|SEP|>e<|SEP|>s", "", None]
    assert values(spark, text.joined(F.col("x")), ["Y<|SEP|>e"]) == ["Ye"]
    assert values(spark, text.tag_text(F.col("x")), ["SANS_SERIF"]) == ["sans-serif"]
    assert values(spark, text.without_space(F.col("x")), ["a b　c\n"]) == ["abc"]
    assert values(spark, text.collapsed(F.col("x")), ["  a \t b "]) == ["a b"]
    assert values(spark, text.is_alphanumeric(F.col("x")), ["é1", "a b", ""]) == [True, False, False]
    assert values(spark, text.drawing_of(F.col("x")), ["<think>a</think>b<svg>c</svg>d", "plain", "<?xml?><svg></svg>"]) == ["<svg>c</svg>", "plain", "<?xml?><svg></svg>"]
    assert values(spark, text.is_base64(F.col("x")), ["YWI=", "YWI", "a b=", None]) == [True, False, False, False]
    assert text.trimmed_names(["run-a.json", "run-bc.json"]) == ["a", "bc"]
    assert text.trimmed_names(["only"]) == ["only"]


def test_compound_tags(spark):
    words = {"high": 3.0, "contrast": 4.0, "sans": 3.0}
    assert values(spark, text.split_compound(F.col("x"), words), ["highcontrast", "zzz", None]) == [["high", "contrast"], ["zzz"], None]


def test_natural_order(spark):
    frame = spark.createDataFrame([("a10",), ("a9",), ("A1",)], "x string")
    assert [r.x for r in frame.orderBy(text.natural_key(F.col("x"))).collect()] == ["A1", "a9", "a10"]


def test_instruction_wording(spark):
    row = spark.createDataFrame([(["SANS_SERIF"], None, "Hand Drawn", None, 400, ["calm", "calm"])], "c array<string>, k array<string>, s string, y string, w int, t array<string>")
    tags = templates.style_tags(*[F.col(c) for c in "ckSywt".lower()])
    got = row.select(tags.alias("t"), templates.style_tags(*[F.col(c) for c in "cksywt"], compat=True).alias("u")).first()
    assert got.t == ["400 weight", "sans-serif", "hand drawn", "calm"]
    assert got.u[0] == "None style"
    assert values(spark, templates.instruction(F.array().cast("array<string>"), F.col("x")), ["ab"]) == ["Text content: a<|SEP|>b\n"]
    assert values(spark, templates.instruction(F.array(F.lit("t")), F.col("x"), apart=False), ["ab"]) == ["Font design requirements: t\n\nText content: ab\n"]


def test_shuffle_is_repeatable(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d"])], "i int, t array<string>")
    once = [r[0] for r in frame.select(templates.shuffled(F.col("t"), 42, F.col("i"))).collect()]
    again = [r[0] for r in frame.repartition(3).orderBy("i").select(templates.shuffled(F.col("t"), 42, F.col("i"))).collect()]
    assert once == again and once[0] != once[1] and sorted(once[0]) == list("abcd")


def test_messages_need_an_instruction(spark):
    frame = spark.createDataFrame([("do", "sys"), ("do", "")], "i string, s string")
    assert [len(r[0]) for r in frame.select(templates.messages(F.col("i"), F.col("s"))).collect()] == [2, 1]
    with pytest.raises(Exception, match="needs messages"):
        spark.createDataFrame([(None, "s")], "i string, s string").select(templates.messages(F.col("i"), F.col("s"))).collect()


def test_token_lengths(spark):
    assert values(spark, tokenize.token_count(F.col("x")), ["ab 12!?", "", None]) == [4, 0, None]
    got = spark.createDataFrame([([1, 2],)], "x array<int>").select(tokenize.fixed_length(F.col("x"), 5, 0, 8, 9)).first()[0]
    assert got == [8, 1, 2, 9, 0]
    with pytest.raises(Exception, match="at most 3"):
        spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(tokenize.fixed_length(F.col("x"), 3, 0, 8, 9)).collect()


DRAWN = '<svg xmlns="http://www.w3.org/2000/svg"><defs/><g fill="#ff0000"><path d="M0 0L10 0L10 10Z" transform="translate(0 5) scale(1 -1)"/></g><path d="M0,0q5 10 10 0" fill="#00ff00"/></svg>'


def test_minify(spark):
    of = lambda f, *texts: values(spark, f(F.col("x")), list(texts))
    assert of(svg.minify_path, "M 1.4 2.6 l -0.5,3", "", None, "M0 0zm1e1-.6.4", "M0 0\nA5 5,0 0 1 9.5 10Z") == ["M1,3l0,3", "", None, "M0,0zm10,-1,0", "M0,0A5,5,0,0,1,10,10Z"]
    assert of(lambda x: svg.minify_path(x, 1), "M0.05 1", "m12345678.94 -0.04") == ["M0.1,1.0", "m12345678.9,0.0"]
    assert of(svg.minify_transform, "translate( 1.6  2 ) scale(2)", " rotate(1)scale( 2 ) ") == ["translate(2,2) scale(2)", "rotate(1)scale(2)"]
    assert of(lambda x: svg.minify_transform(x, tight=True), "translate(1 2) scale(2)") == ["translate(1,2)scale(2)"]
    assert of(svg.minify, "<a id='M 1 2' d='M 1 2'>\n <b/></a>") == ["<a id='M 1 2' d='M1,2'><b/></a>"]
    assert of(svg.minify, '<g transform="scale(1.6)">\n<path data-d="1.5 2" d="M 1.5 2" transform=\'rotate( 1.4 )\' />\t<text>d t</text></g>') == ['<g transform="scale(2)"><path data-d="1.5 2" d="M2,2" transform=\'rotate(1)\' /><text>d t</text></g>']
    assert of(svg.minify, '<path d="' + "M1.5 2" * 50_000 + '"/>') == ['<path d="' + "M2,2" * 50_000 + '"/>']


def test_boxes_and_bake():
    assert svg.bounding_box(DRAWN) == pytest.approx((0, -5, 10, 10))
    baked = svg.bake(DRAWN)
    assert "transform" not in baked and 'd="M0,5l10,0l0,-10z"' in baked and 'viewBox="0 -5 10 10"' in baked
    assert svg.bounding_box(baked) == pytest.approx((0, -5, 10, 10))
    with pytest.raises(ValueError):
        svg.bake(DRAWN, scale=False)
    assert paths.box(paths.parse("M0 0A5 5 0 0 1 10 0")) == pytest.approx((0, -5, 10, 5))
    assert paths.box(paths.parse("M0 0C0 10 10 10 10 0"))[3] == pytest.approx(7.5)
    assert paths.box(paths.parse("M1 1")) is None


def test_encode_fills():
    lines = svg.encode(DRAWN).splitlines()
    assert lines[0].startswith("<path") and 'fill="#ff0000"' in lines[0] and len(lines) == 2
    grad = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><defs><linearGradient id="a"><stop stop-color="#102030"/></linearGradient><radialGradient id="b" xlink:href="#a"/></defs><path fill="url(#b)" d="M0 0"/><path d="M1 1"/></svg>'
    assert svg.encode(grad) == '<path fill="#102030" d="M0 0"/>\n<path d="M1 1" fill="#102030"/>\n'
    assert 'fill="#000000"' in svg.encode(grad, "default") and "fill" not in svg.encode(grad, "skip").splitlines()[1]


def test_repair():
    assert svg.repaired('noise<path d="M0 0l1 1"/>\n<path d="M0 0l1 1 2') == '<path d="M0 0l1 1"/>\n<path d="M0 0"/>\n'
    assert svg.repaired('<path d="M0 0l1 1"/>\n<pa') == '<path d="M0 0l1 1"/>\n'
    assert svg.repaired("") == "" and svg.repaired("no drawing") == ""
    assert svg.decode("") == '<svg xmlns="http://www.w3.org/2000/svg">\n</svg>'


def test_sampling_by_length():
    assert paths.sampled(paths.parse("M0 0H10V10"), 5).tolist() == [[0, 0], [5, 0], [10, 0], [10, 5], [10, 10]]
    circle = paths.sampled(paths.parse("M0 0A5 5 0 0 1 10 0A5 5 0 0 1 0 0"), 100)
    assert all(abs(math.hypot(x - 5, y) - 5) < 1e-6 for x, y in circle)
    assert paths.sampled(paths.parse("M3 4z"), 3).tolist() == [[3, 4]] * 3
    assert len(svg.points('<svg><path d="M0 0h9"/><path d="M0 1h9"/></svg>', 10)) == 10
    assert len(svg.points('<svg><path d="M0 0h9"/><path d="M0 1h9"/></svg>', 10, per_path=True)) == 20


number = st.integers(-50, 50)
commands = st.lists(st.one_of(st.tuples(st.just("l"), st.lists(number, min_size=2, max_size=2)), st.tuples(st.just("q"), st.lists(number, min_size=4, max_size=4)), st.tuples(st.just("c"), st.lists(number, min_size=6, max_size=6)), st.tuples(st.just("h"), st.lists(number, min_size=1, max_size=1))), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(commands)
def test_paths_round_trip(parts):
    data = "M0 0" + "".join(c + " ".join(map(str, v)) for c, v in parts)
    for relative in (True, False):
        assert paths.same(data, paths.written(paths.parse(data), relative), 1e-6)
    document = f'<svg xmlns="http://www.w3.org/2000/svg"><path d="{data}"/></svg>'
    once = svg.encode(document)
    assert svg.encode(svg.decode(once)) == once


def test_broken_documents_give_null(spark):
    got = values(spark, svg.box_column(F.col("x")), [DRAWN, "<svg", None])
    assert got[0] == pytest.approx([0, -5, 10, 10]) and got[1:] == [None, None]
    assert values(spark, svg.survives_coding(F.col("x")), [DRAWN, "<svg", None]) == [True, False, False]
    coded = values(spark, svg.coded_column(F.col("x")), [DRAWN, "<svg", None])
    assert coded[0].sound and coded[0].lines == svg.encode(DRAWN) and [c.lines for c in coded[1:]] == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["path", "g", "rect"]), st.sampled_from(["", ' fill="#102030"', ' fill="none"', ' id="a&amp;b"', ' d="M0 0l1 1"', " d='M0 0'", ' d="M0&#10;0"', ' x="&lt;"'])), max_size=6))
def test_sound_without_reading_again(parts):
    lines = svg.encode(f'<svg xmlns="{svg.NAMESPACE}">' + "".join(f"<{kind}{attribute}/>" for kind, attribute in parts) + "</svg>")
    assert svg.sound(lines) == (svg.encode(svg._document(svg.repaired(lines))) == lines)


def test_older_instruction(spark):
    row = spark.createDataFrame([(["SANS_SERIF", "SANS_SERIF"], ["HAND_DRAWN"], "slab_serif", None, 400, ["/look/it's-calm", "x"])], "c array<string>, k array<string>, s string, y string, w int, t array<string>")
    tags = lambda **options: templates.prefixed_tags(*[F.col(c) for c in "cksywt"], **options)
    got = row.select(templates.titled_instruction(tags(), F.lit("Ab")).alias("a"), tags(compat=True).alias("b"), templates.titled_instruction(F.array().cast("array<string>"), F.lit("Ab")).alias("c")).first()
    assert got.a == "Font design requirements: Category Sans Serif, Classification Hand Drawn, Stroke Slab Serif, Weight 400, Look It'S-Calm, X\n\nText content: Ab"
    assert got.b[3:5] == ["Style None", "Weight 400"] and got.c == "Text content: Ab"
