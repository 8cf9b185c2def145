"""Problem 9: one consistent form for text that looks the same but differs in its characters.

A text is cut into plain runs and clusters: a cluster is one character with the marks and invisible characters
after it. Only the distinct clusters of the corpus are worked on: they are exploded to positioned code points, joined with
a broadcast table of decompositions and look-alikes (its size is bounded by Unicode), their combining marks ordered
by class, recomposed and put back together; then the texts are rebuilt from their clusters.

What is folded: canonical and width variants, no-break and spacing variants of the blank, line ends, ligatures,
Roman numerals, radicals, look-alike letters, invisible characters. What stays apart: letter case, accents, digits,
raised and circled forms, styled letters, tabs, and joiners and variation selectors inside emoji.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold import store
from inkfold.operators.skew import salted_join

# Letters and marks of other scripts drawn like Latin ones, as source and target.
LOOKALIKES = {
    "Cyrillic small letters": ("аеорсухѕіјһԁԛԝӏ", "aeopcyxsijhdqwl"),
    "Cyrillic capital letters": ("АВЕКМНОРСТХЅІЈԌԚԜ", "ABEKMHOPCTXSIJGQW"),
    "Greek small letters": ("ονϲϳ", "ovcj"),
    "Greek capital letters": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    "Armenian letters": ("օսհո", "ouhn"),
    "Coptic letters": ("ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "BHIKMNOoPpCcTYX"),
    "Cherokee letters": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB"),
    "Lisu letters": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "hyphens": ("‐‑", "--"),
}
# Ranges of code points that show nothing by themselves.
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
# Ranges whose compatibility characters look like what they decompose to.
COMPAT = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB04), (0xFB06, 0xFB06))
# Line ends beside CR and LF; the blank that is drawn as a stroke.
LINE_ENDS, OGHAM = "\u0085  ", " "
# Ranges of signs and emoji, after which a joiner or variation selector changes what is seen.
PICTURES = ((0x2190, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x1F000, 0x1FAFF))
KEPT_IN_PICTURES = "‍︎️"


def _set(*ranges: tuple[int, int]) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


#: What belongs to the character before it: marks, invisible characters, half-width sound marks, conjoining vowels and trailing consonants.
_HANG = _set(*INVISIBLE, (0x1160, 0x11FF), (0xD7B0, 0xD7FB)) + r"\p{M}\x{ff9e}\x{ff9f}"
#: A plain run ends before a character to which something is attached.
CLUSTERS = rf"(?s)[\x00-\x7f]+(?![{_HANG}])|.[{_HANG}]*"
_PICTURE = f"^[{_set(*PICTURES)}]"


def _within(n: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= n <= b for a, b in ranges)


def _becomes(ch: str, look: dict[str, str]) -> str:
    """What one character becomes before marks are ordered."""
    if _within(ord(ch), INVISIBLE):
        return ""
    if ch in LINE_ENDS:
        return "\n"
    if unicodedata.category(ch) == "Zs" and ch != OGHAM:
        return " "
    if 0xAC00 <= ord(ch) <= 0xD7A3:  # syllables stay whole
        return ch
    tag = unicodedata.decomposition(ch).split(" ", 1)[0]
    folded = tag in ("<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and _within(ord(ch), COMPAT)
    parts = unicodedata.normalize("NFKD" if folded else "NFD", ch)
    return unicodedata.normalize("NFD", "".join(look.get(c, c) for c in parts))


@cache
def _changes() -> tuple:
    """The rows of ``mapping``, made once."""
    look = {a: b for source, target in LOOKALIKES.values() for a, b in zip(source, target, strict=True)}
    rows = []
    for n in range(0x80, sys.maxunicode + 1):
        ch = chr(n)
        if unicodedata.category(ch) not in ("Cn", "Cs", "Co"):
            to = _becomes(ch, look)
            if to != ch or unicodedata.combining(ch):
                rows.append((ch, [(c, unicodedata.combining(c)) for c in to]))
    return tuple(rows)


def mapping(spark: SparkSession) -> DataFrame:
    """``(cp, parts array<struct<c, k>>)``: what a character becomes, with combining classes; others stay as they are.

    Made from Python's Unicode tables: a row a code point that changes or combines, about 5,000.
    """
    return spark.createDataFrame(_changes(), "cp string, parts array<struct<c: string, k: int>>")


@cache
def compositions() -> dict[str, str]:
    """``{starter + mark: composite}`` of the primary composites (about 940); Hangul is composed by rule."""
    out = {}
    for n in range(0xA0, sys.maxunicode + 1):
        kind = unicodedata.decomposition(chr(n))
        if " " in kind and kind[0] != "<" and unicodedata.normalize("NFC", chr(n)) == chr(n):
            out["".join(chr(int(x, 16)) for x in kind.split())] = chr(n)
    return out


def _hangul(a: Column, b: Column) -> Column:
    """The syllable of a leading consonant and a vowel, or of such a syllable and a trailing consonant; else null."""
    x, y = F.ascii(a), F.ascii(b)
    lv = F.when(x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175), F.lit(0xAC00) + ((x - 0x1100) * 21 + (y - 0x1161)) * 28)
    lvt = F.when(x.between(0xAC00, 0xD7A3) & (F.pmod(x - 0xAC00, F.lit(28)) == 0) & y.between(0x11A8, 0x11C2), x + (y - 0x11A7))
    return F.decode(F.unhex(F.hex(F.coalesce(lv, lvt))), "UTF-16BE")


def _recomposed(marks: Column, pairs: Column) -> Column:
    """Canonical composition of an ordered array of ``<c, k>``.

    A fold over what is done, the last starter, what stands after it and the last class there. A mark composes
    unless one of the same or a higher class stands between it and the starter, a starter only right behind it.
    """
    none = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        free = (acc["starter"] != "") & ((acc["last"] == -1) | (acc["last"] < x["k"]))
        both = F.when(free, F.coalesce(F.try_element_at(pairs, F.concat(acc["starter"], x["c"])), _hangul(acc["starter"], x["c"])))
        joined = F.struct(acc["done"].alias("done"), both.alias("starter"), acc["tail"].alias("tail"), acc["last"].alias("last"))
        fresh = F.struct(F.concat(acc["done"], acc["starter"], acc["tail"]).alias("done"), x["c"].alias("starter"), F.lit("").alias("tail"), F.lit(-1).alias("last"))
        behind = F.struct(acc["done"].alias("done"), acc["starter"].alias("starter"), F.concat(acc["tail"], x["c"]).alias("tail"), x["k"].alias("last"))
        return F.when(both.isNotNull(), joined).when(x["k"] == 0, fresh).otherwise(behind)

    return F.aggregate(marks, none, step, lambda acc: F.concat(acc["done"], acc["starter"], acc["tail"]))


def consistent_clusters(clusters: DataFrame) -> DataFrame:
    """``(cluster)``, distinct -> ``(cluster, form)``."""
    spark = clusters.sparkSession
    points = clusters.select("cluster", F.posexplode(F.split("cluster", "")).alias("pos", "cp"))
    points = points.join(F.broadcast(mapping(spark)), "cp", "left")
    itself = F.array(F.struct(F.col("cp").alias("c"), F.lit(0).alias("k")))
    seen = F.col("cluster").rlike(_PICTURE) & F.col("cp").isin(*KEPT_IN_PICTURES)
    parts = points.select("cluster", "pos", F.posexplode_outer(F.when(seen, itself).otherwise(F.coalesce("parts", itself))).alias("sub", "part"))
    order = Window.partitionBy("cluster").orderBy("pos", "sub")
    placed = parts.withColumn("start", F.sum(F.when(F.col("part.k") == 0, 1).otherwise(0)).over(order))
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("start", F.col("part.k").alias("k"), "pos", "sub", F.col("part.c").alias("c")))))
    pairs = F.from_json(F.lit(json.dumps(compositions())), "map<string,string>")
    return placed.groupBy("cluster").agg(sorted_.alias("marks")).select("cluster", _recomposed(F.col("marks"), pairs).alias("form"))


def consistent(rows: DataFrame, key: str, text: str, out: str = "consistent") -> DataFrame:
    """``rows`` with ``out``, the consistent form of ``text``; null stays null, empty stays empty.

    ``key`` should be unique: rows of one key are rebuilt from one set of clusters, which stays right if it isn't.
    All columns are kept; ``out`` replaces a column of that name.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(CLUSTERS), F.lit(0))
    found = rows.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("_inkfold_key"), F.explode(F.filter(F.array_distinct(cut), lambda c: c.rlike(r"[^\x00-\x7f]"))).alias("cluster"))
    forms = consistent_clusters(found.select("cluster").distinct()).filter("form <> cluster")
    changed = salted_join(found, forms, "cluster", F.col("_inkfold_key")).groupBy("_inkfold_key").agg(F.map_from_entries(F.collect_set(F.struct("cluster", "form"))).alias("_inkfold_forms"))
    joined = rows.join(changed, F.col(key).eqNullSafe(F.col("_inkfold_key")), "left")
    rebuilt = F.array_join(F.transform(cut, lambda c: F.coalesce(F.try_element_at(F.col("_inkfold_forms"), c), c)), "")
    form = F.regexp_replace(F.when(F.col("_inkfold_forms").isNull(), F.col(text)).otherwise(rebuilt), "\r\n?", "\n")
    return joined.withColumn("_inkfold_form", form).drop("_inkfold_key", "_inkfold_forms").withColumn(out, F.col("_inkfold_form")).drop("_inkfold_form")


def alike_pairs(forms: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """``(doc_a, doc_b)``, a < b, of rows whose texts differ and whose forms are equal; null and blank forms pair with nothing.

    Texts of a form are paired first, then each pair of texts with its rows: exact copies are never compared.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c)))
    seen = forms.filter(F.col(form).rlike(r"(?U)\S")).select(F.col(key).alias("doc"), digest(form).alias("form"), digest(text).alias("text"))
    texts = seen.select("form", "text").distinct()
    several = texts.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    texts = texts.join(several, "form", "left_semi")
    pairs = texts.alias("x").join(texts.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.text") < F.col("y.text"))).select(F.col("x.form").alias("form"), F.col("x.text").alias("tx"), F.col("y.text").alias("ty"))
    left = pairs.join(seen.select("form", F.col("text").alias("tx"), F.col("doc").alias("dx")), ["form", "tx"])
    both = left.join(seen.select("form", F.col("text").alias("ty"), F.col("doc").alias("dy")), ["form", "ty"])
    return both.select(F.least("dx", "dy").alias("doc_a"), F.greatest("dx", "dy").alias("doc_b"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hashed = consistent(docs, "doc_id", "text", "form").filter("text IS NOT NULL")
    return alike_pairs(store.written(hashed, "forms"), "doc_id", "text", "form")


QUERIES = {"p9_found": p9_found}
ORACLES: dict[str, str] = {}
