"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "<|SEP|>"


def tag_text(tag: Column) -> Column:
    """``SANS_SERIF`` -> ``sans-serif``."""
    return F.lower(F.translate(tag, "_", "-"))


def separated(text: Column, separator: str = SEPARATOR) -> Column:
    """``Yes`` -> ``Y<|SEP|>e<|SEP|>s``; empty stays empty."""
    return F.array_join(F.split(text, ""), separator)


def joined(text: Column, separator: str = SEPARATOR) -> Column:
    """The text without separators."""
    return F.replace(text, F.lit(separator), F.lit(""))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_alphanumeric(text: Column) -> Column:
    """Letters and numbers of any script only, at least one."""
    return text.rlike(r"^[\p{L}\p{N}]+$")


def drawing_of(answer: Column) -> Column:
    """The SVG document of an answer: thinking removed, the first one with an XML head if there is one; else the text itself."""
    plain = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    headed = F.regexp_extract(plain, r"(?s)(<\?xml.*?</svg>)", 1)
    bare = F.regexp_extract(plain, r"(?s)(<svg.*?</svg>)", 1)
    return F.when(headed != "", headed).when(bare != "", bare).otherwise(plain)


def natural_key(text: Column) -> Column:
    """An array that sorts as people do: digit runs by value, what stands between them by letter."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit(0)).otherwise(F.lit(1)).alias("k"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)).alias("n"), p.alias("s")))


def contains_any(columns: list[Column], query: str) -> Column:
    """Whether any of the columns holds the query, letter case aside; nulls hold nothing."""
    wanted = F.lit(query.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c.cast("string")), wanted), F.lit(False)) for c in columns])


def trimmed_names(names: list[str]) -> list[str]:
    """A short list of names without what all of them begin and end with; a single name stays."""
    if len(names) < 2:
        return list(names)
    start = len(commonprefix(names))
    rest = [n[start:] for n in names]
    end = len(commonprefix([n[::-1] for n in rest]))
    return [n[: len(n) - end] if end else n for n in rest]


def split_compound(tag: Column, words: dict[str, float]) -> Column:
    """Array of the words that a compound is most likely made of; the compound itself if it falls into single letters.

    ``words`` gives each word's cost (its negative log frequency); unknown single letters cost more than any word.
    """
    longest = max(map(len, words), default=1)
    unknown = max(words.values(), default=1.0) * 4 + 10

    def cut(text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = ((best[end - n][0] + words.get(text[end - n : end].lower(), unknown if n == 1 else float("inf")), n) for n in range(1, min(end, longest) + 1))
            best.append(min(options))
        out, end = [], len(text)
        while end:
            out.append(text[end - best[end][1] : end])
            end -= best[end][1]
        return out[::-1]

    @F.pandas_udf("array<string>")
    def parts(tags: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            found = [w for piece in t.split() for w in cut(piece)]
            return [t] if all(len(w) == 1 for w in found) else found

        return tags.map(one)

    return parts(tag)


def path_part(path: Column, at: int) -> Column:
    """A part of a path, counted from 1, or from the end if negative; null beyond."""
    return F.try_element_at(F.split(path, "/"), F.lit(at))


def is_base64(text: Column) -> Column:
    """Whether the text is canonical base64: whole quads that decode and encode back to it."""
    raw = F.try_to_binary(text, F.lit("base64"))
    again = F.regexp_replace(F.base64(raw), r"[\r\n]", "")
    return F.coalesce((F.length(text) % 4 == 0) & raw.isNotNull() & (again == text), F.lit(False))


def base64_of(data: Column) -> Column:
    """Base64 in one line, whatever the session says about chunks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")
