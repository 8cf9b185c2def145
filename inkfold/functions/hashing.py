"""Keys: digests of text and the identifiers made of them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blake2_key(text: Column, digest_size: int = 16, chars: int = 16) -> Column:
    """The first ``chars`` hexadecimal digits of blake2b of the UTF-8 text; null stays null.

    ``digest_size`` is part of the hash: another size gives an unrelated value. Spark has no blake2, so this is a
    vectorised UDF; where only identity matters, ``F.sha2`` stays in the JVM.
    """

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=digest_size).hexdigest()[:chars])

    return digest(text)


def sha256_key(text: Column, chars: int = 20) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def glyph_key(family: Column, filename: Column, content: Column) -> Column:
    """Key of one rendered text of one font."""
    return blake2_key(F.concat_ws("|", family, filename, content))


def word_key(filename: Column, text: Column) -> Column:
    return sha256_key(F.concat(filename, F.lit(":"), text))


def identifier(family: Column, filename: Column) -> Column:
    """``family/filename``; null if either is."""
    return F.concat(family, F.lit("/"), filename)


def file_digest(content: Column) -> Column:
    return F.md5(content)


def sample_id(row_idx: Column, record: Column, *given: Column) -> Column:
    """The first given id, else the row number and 16 digits of sha1 of the record as JSON.

    ``record`` is a struct with its fields in alphabetical order, so that equal records have equal JSON.
    """
    made = F.concat(row_idx.cast("string"), F.lit(":"), F.substring(F.sha1(F.to_json(record)), 1, 16))
    return F.coalesce(*[g.cast("string") for g in given], made)


def path_content(svg: Column) -> Column:
    """The ``d`` of all paths of a text, joined by line ends; empty if there is none."""
    return F.array_join(F.regexp_extract_all(svg, F.lit(r'(?is)<path[^>]*?\sd="([^"]*)"'), F.lit(1)), "\n")
