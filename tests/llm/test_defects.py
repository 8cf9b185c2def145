from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkfold.llm import defects, refusals

SCHEMA = "sample_id string, instruction string, predict string, label string, paths int, words string"
DRAW = "Style wanted: sans-serif\n\nText to draw: a<|SEP|>b\n"
PATH = '<path d="M1 2l3 4z"/>'
LOOK = "Describe the look of this typeface in a few sentences. It carries the tags plain."
READ = "Read the text drawn in the picture and answer with that text only."
CASES = [
    (DRAW, None, "empty"),
    (DRAW, "", "empty"),
    (DRAW, " ​\n", "empty"),
    (DRAW, "```svg\n\n```", "empty"),
    (DRAW, '<svg viewBox="0 0 1 1">\n</svg>', "empty"),
    (LOOK, "N/A", "empty"),
    (LOOK, "[]", "empty"),
    (DRAW, "<think>\nSimple.\n</think>\n", "empty"),
    (DRAW, PATH + PATH, None),
    (DRAW, f"Here is the outline:\n{PATH}\n{PATH}", None),
    (DRAW, f"```svg\n{PATH}\n{PATH}\n```", None),
    (DRAW, PATH.replace("/>", "></path>") * 2, None),
    (DRAW, PATH, "truncated"),
    (DRAW, PATH + '<path d="M1 2l3', "truncated"),
    (DRAW, '<path d="M1', "truncated"),
    (DRAW, "<think>\nStart with the stem, then", "truncated"),
    (LOOK, "The stem is stiff. Nobody could mistake this q for a", "truncated"),
    (LOOK, "The stem is stiff.\n- airy\n- blunt", None),
    (LOOK, "Short answer: optically heavy", None),
    (LOOK, "**The stem is stiff.**", None),
    (DRAW, "I'm sorry, but I can't generate SVG code.", "refusal"),
    (DRAW, "<!-- cannot comply with the request -->", "refusal"),
    (READ, "It would not be appropriate for me to answer this.", "refusal"),
    (LOOK, "Unfortunately I do not have the means to describe typefaces.", "refusal"),
    (LOOK, "Leider kann ich das nicht beschreiben.", "refusal"),
    (LOOK, "Sorry-looking serifs aside, the stem is stiff, and our decoder can't handle it.", None),
    (DRAW, DRAW, "copy"),
    (DRAW, "TEXT TO DRAW: A<|SEP|>B", "copy"),
    (LOOK, "You said: " + LOOK, "copy"),
    (LOOK, "Describe the look of typeface in a few sentences.", "copy"),
    (LOOK, "You asked about the look of these letters. The stem is stiff.", None),
    (DRAW, f"Hier ist der gewünschte Pfad:\n{PATH}\n{PATH}", "language"),
    (DRAW, "見出しでははらいの長さが目立つ。", "language"),
    (LOOK, "Krój powstał dla książek, później użyto go do nagłówków.", "language"),
    (READ, "Das Bild zeigt den Text „pa“.", "language"),
    ("Décris l'allure de cette police en quelques phrases. Mots clés : plain.", "Le dessin paraît serré, surtout dans la traverse.", None),
    (READ, "é", None),
    (READ, "M a b e f a h a", None),
    (READ, "'", None),
    (READ, 'The text reads "zu".', None),
]


def test_every_kind(spark):
    rows = [(str(k), i, p, None, 0, "x") for k, (i, p, _) in enumerate(CASES)]
    got = {r.sample_id: r.defect for r in defects.defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: got.get(str(k)) for k in range(len(CASES))} == {k: want for k, (_, _, want) in enumerate(CASES)}


def test_nulls_repeats_and_long_texts(spark):
    rows = [("a", None, "x " * 200_000, None, 0, ""), ("b", DRAW, None, None, 0, ""), ("b", DRAW, None, None, 0, ""), (None, None, None, None, 0, ""), ("c", DRAW, PATH * 20_000, None, 0, "")]
    got = {r.sample_id: r.defect for r in defects.defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": "truncated", "b": "empty", None: "empty"}
    assert defects.defects(spark.createDataFrame([], SCHEMA)).count() == 0
    assert defects.defects(spark.createDataFrame(rows, SCHEMA), label=None).count() == 3


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert defects.lcs(a, b) == table[-1][-1]


@pytest.mark.parametrize("text, lang", [("The stem is stiff and it stays so.", "en"), ("Der Schaft ist schmal und bleibt so.", "de"), ("Он не был там", "ru"), ("sans-serif, techno-ui", None), ("Kogil", None)])
def test_language(text, lang):
    assert defects.language(text) == lang


@pytest.mark.parametrize(
    "prompt, answer, label, want",
    [
        (DRAW, "Here is the outline:", None, "truncated"),
        (DRAW, "Sure! The letters follow below.", None, "truncated"),
        (DRAW, "I'm going to pass on this one.", None, "refusal"),
        (READ, "The picture shows the word Kobu", "Zarel", None),
        (READ, "I am really going to pass here.", "Zarel", "refusal"),
        (LOOK, "I'm going to pass on this one.", None, "refusal"),
        (LOOK, "I'm just not able to do this.", None, "refusal"),
        (LOOK, "I have to say the stem is stiff.", None, None),
        (LOOK, "I am going to use it, as it is able to carry a page.", None, None),
    ],
)
def test_alignment_decides_refusals(prompt, answer, label, want):
    asked = 2 if prompt == DRAW else None
    assert defects.judge(prompt, answer, 0, asked, False, label) == want


# Wordings that no template spells out, in fifteen languages.
DECLINING = """
Sorry, I can't help with that.
I'm afraid I am not able to create these outlines.
That is something I have decided against answering.
I have decided not to draw this one.
We're unable to process the image you sent.
I must respectfully decline this drawing request.
This falls outside of what I can do.
My guidelines do not permit me to produce this.
It isn't possible for me to view pictures.
Regrettably, your request cannot be completed.
I'd prefer not to describe fonts.
I'm only a text model, so pictures are beyond me.
Drawing is beyond my capabilities.
Please contact a professional illustrator instead.
No drawing can be provided.
Ich kann dir dabei leider nicht helfen.
Es tut mir leid, das geht nicht.
Das muss ich leider ablehnen.
Je ne peux pas dessiner ces lettres.
Désolé, ce n'est pas possible.
No puedo generar ese código.
Lo siento, no es posible.
Non posso disegnare queste lettere.
Mi dispiace, ma non lo faccio.
Não posso ajudar com isso.
Nie mogę narysować tych liter.
Niestety nie jestem w stanie tego opisać.
Ik kan dit helaas niet tekenen.
Jag kan tyvärr inte rita detta.
Bohužel vám s tím nemohu pomoci.
Üzgünüm, bunu yapamam.
Xin lỗi, tôi không thể vẽ chữ này.
Я не могу нарисовать эти буквы.
К сожалению, я не могу помочь.
Δεν μπορώ να σχεδιάσω αυτά τα γράμματα.
申し訳ありませんが、描けません。
この文字を描くことはできません。
抱歉,我无法绘制这些字母。
죄송합니다. 그릴 수 없습니다.
""".strip().splitlines()
# Prose that uses the same words without declining.
NEUTRAL = """
The weather is nice and calm today.
The picture holds the word hello twice over.
The counters cannot be read at small sizes, yet the stem is stiff.
I have to say the stem is stiff.
We like how the serifs refuse to shout.
I would pass this face on to a book designer.
As a text face it is not bad at all.
One can not praise the terminals enough.
It does not allow tight tracking.
The design does not ask for attention.
Die Serifen sind nicht schmal, aber kräftig.
Man kann die Punzen nicht übersehen.
Les empattements ne sont pas lourds.
No es una letra fina, pero se puede leer bien.
Il tratto non è pesante.
Nie jest to krój wąski.
De schreven zijn niet zwaar.
Буквы не слишком широкие.
這個字體不是很重。
I am going to use it, as it is able to carry a page.
It will not disappoint in headlines.
A typeface for someone who must decide fast.
The letters show no contrast, and they do not need any.
Please note how the bowl closes.
The rules of the grid are plain.
""".strip().splitlines()


@pytest.mark.parametrize("answer", DECLINING)
def test_held_out_refusals(answer):
    assert refusals.refuses(answer) and refusals.refuses("The letters first. " + answer + " Perhaps another tool will do.")


@pytest.mark.parametrize("answer", NEUTRAL)
def test_prose_that_declines_nothing(answer):
    assert not refusals.refuses(answer)
    assert defects.judge(DRAW, answer, 0, 2, False, None) != "refusal"


def test_alignment_with_gaps():
    slots, free = refusals._template("I cannot ACT")
    score = lambda text, free=0: refusals.score(slots, refusals.tokens(text), free)
    assert score("I can't draw") == 1 and score("well, I cannot, sadly, draw it") == pytest.approx(1 - refusals.GAP / 2.6)
    assert score("I cannot for the life of me draw") < refusals.ALIGNED < score("I cannot for the life of me draw", 8)
    assert score("draw what I cannot") == pytest.approx(1.6 / 2.6) and score("") == 0
    assert all(0 < weight <= 1 and words for slots, _ in refusals.templates() for words, weight in slots)


@pytest.mark.parametrize(
    "lang, text",
    [
        ("de", "Schlanke Buchstaben zeichnen ruhige Zeilen"),
        ("fr", "Lettres fines tracées proprement restent lisibles"),
        ("es", "Letras finas trazadas mantienen continuación limpia"),
        ("pl", "Litery cienkie zawsze czytelnie wyglądają użyte"),
        ("cs", "Písmena vypadají klidně také těsně sázená"),
        (None, "Lettere sottili scritte ordinatamente restano leggibili"),
        ("en", "Slender letters follow each other calmly"),
        (None, "Kogil Bari Fato Zarel Kobu"),
    ],
)
def test_language_by_pairs_of_letters(lang, text):
    assert defects.by_grams(text.casefold().split()) == lang
    assert defects.by_grams(text.split()[:4]) is None
