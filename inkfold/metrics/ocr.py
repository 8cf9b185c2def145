"""Grading of transcriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import SEPARATOR, without_space


def parsed(text: Column, *, use_case: bool, remove_space: bool) -> Column:
    """A text as it is compared: trimmed, without separators; without any space and letter case if so wanted."""
    bare = F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(SEPARATOR), F.lit(""))
    bare = without_space(bare) if remove_space else bare
    return bare if use_case else F.lower(bare)


def graded(rows: DataFrame, predict: str, truth: Column, *, use_case: bool = True, remove_space: bool = False) -> DataFrame:
    """Rows with ``parsed_predict``, ``parsed_gt`` and ``score``; space is removed from the prediction only. A null on either side gives
    a null score."""
    p = parsed(F.col(predict), use_case=use_case, remove_space=remove_space)
    t = parsed(truth, use_case=use_case, remove_space=False)
    return rows.withColumn("parsed_predict", p).withColumn("parsed_gt", t).withColumn("score", F.col("parsed_predict") == F.col("parsed_gt"))
