"""Tokenizers behind one interface, for lengths and listings; results compare only within one tokenizer."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts -> ids of each.
Tokenizer = Callable[[list[str]], list[list[int]]]


@cache
def from_file(path: str) -> Tokenizer:
    """A tokenizer of the ``tokenizers`` library; special tokens' strings are ordinary text."""
    from tokenizers import Tokenizer as Library

    loaded = Library.from_file(path)
    loaded.encode_special_tokens = True
    return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]


def pieces(text: Column) -> Column:
    """The default tokenizer, in the JVM: runs of letters, runs of digits, single other signs."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), F.lit(0))


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text by the tokenizer in a file, or by the default one; null for null."""
    if path is None:
        return F.size(pieces(text)).cast("bigint")

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype="Int64", index=texts.index)
        out[known] = [len(ids) for ids in from_file(path)(texts[known].tolist())]
        return out

    return count(text)


def length_statistics(instruction: Column, system: Column, output: Column, content: Column, path: str | None = None) -> list[Column]:
    """Characters and tokens of the input (instruction, blank, system), of the output, and characters of the content without separators."""
    asked = F.concat(instruction, F.lit(" "), system)
    return [
        F.length(asked).cast("bigint").alias("input_str_len"),
        token_count(asked, path).alias("input_token_len"),
        F.length(output).cast("bigint").alias("output_str_len"),
        token_count(output, path).alias("output_token_len"),
        F.length(F.replace(content, F.lit("<|SEP|>"), F.lit(""))).cast("bigint").alias("content_len"),
    ]


def fixed_length(ids: Column, size: int = 77, pad: int = 0, begin: int | None = None, end: int | None = None, truncate: bool = False) -> Column:
    """Ids between the begin and end marks, padded to ``size``; longer ones are cut (keeping the end mark) or raise."""
    marks = lambda x: F.array() if x is None else F.array(F.lit(x))
    full = F.concat(marks(begin).cast("array<int>"), ids, marks(end).cast("array<int>"))
    padded = F.concat(full, F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(full), F.lit(0))))
    cut = F.concat(F.slice(full, 1, size - 1), F.slice(full, -1, 1)) if end is not None else F.slice(full, 1, size)
    too_long = cut if truncate else F.raise_error(F.concat(F.lit("text of "), F.size(full).cast("string"), F.lit(f" tokens; at most {size}"))).cast("array<int>")
    return F.when(F.size(full) <= size, padded).otherwise(too_long)
