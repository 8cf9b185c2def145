"""Queries over whole tables, against brute force on small ones."""

from __future__ import annotations

import unicodedata

from inkfold.plans import catalogue

from .conftest import DATA


def pieces(text: str | None) -> list[str]:
    """Runs of letters, runs of digits, single other signs."""
    out, before = [], ""
    for c in text or "":
        kind = "" if c in " \t\n\v\f\r" else unicodedata.category(c)[0]
        if kind in ("L", "N") and kind == before:
            out[-1] += c
        elif kind:
            out.append(c)
        before = kind
    return out


def test_token_listing_of_all_documents(spark, tmp_path):
    texts = ["wide, calm 12px", "Größe ½ – 3e4\tx", "明朝体。4", "é̂ 👍🏽 _a_", '<path d="M1.5 2z"/>', "", " \n", None]
    docs = [(k, t, lang, kind) for k, (t, lang, kind) in enumerate((t, lang, kind) for t in texts for lang in ("en", "de", None) for kind in ("tags", "review", "log", None))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["token_listing"](spark, str(tmp_path)).collect())
    assert got == sorted((k, n, p) for k, t, _, _ in docs for n, p in enumerate(pieces(t)))


def test_sorted_frequency_of_all_fields(spark, tmp_path):
    rows = [(["sans"], ["wide", "calm"], None, [], "bold", 400, "a", None), (["sans"], ["calm", "tall"], None, [], None, 400, "b", None)]
    schema = "category array<string>, tags array<string>, classifications array<string>, spacings array<string>, style string, weight int, source string, stroke string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/font_meta.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["sorted_frequency"](spark, str(tmp_path)).collect()}
    assert got == {("category", 1, "sans", 2), ("tags", 1, "calm", 2), ("tags", 2, "tall", 1), ("tags", 3, "wide", 1), ("style", 1, "bold", 1), ("weight", 1, "400", 2), ("source", 1, "a", 1), ("source", 2, "b", 1)}


def test_dataset_has_all_contents(spark):
    contents = spark.read.parquet(f"{DATA}/content.parquet").filter("content IS NOT NULL").select("content").distinct().count()
    got = catalogue.QUERIES["dataset_build"](spark, str(DATA)).collect()
    assert got and all(r.rows == r.fonts * contents for r in got)
