"""Word tables of an OCR engine: lines of twelve values between tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns in their order.
COLUMNS = "level page_num block_num par_num line_num word_num left top width height conf text".split()


def _lines(tables: DataFrame, key: str, text: str) -> DataFrame:
    lines = tables.select(F.col(key), F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_line"))
    return lines.select(key, "_line", F.split("_line", "\t").alias("_v"))


def read_words(tables: DataFrame, key: str, text: str = "tsv") -> DataFrame:
    """(key, the twelve columns) of every line with at least twelve values; shorter lines are skipped (see line_counts). A number that can't be read is null, so headers have no level."""
    kinds = {"conf": "double", "text": "string"}
    value = lambda i, name: F.get("_v", F.lit(i)).try_cast(kinds.get(name, "int")).alias(name)
    return _lines(tables, key, text).filter(F.size("_v") >= len(COLUMNS)).select(key, *[value(i, name) for i, name in enumerate(COLUMNS)])


def line_counts(tables: DataFrame, key: str, text: str = "tsv") -> DataFrame:
    """(key, words, other, skipped) per table: lines of level 5, whole lines of other levels, and lines of fewer than twelve values; a blank line is none of these."""
    whole, level = F.size("_v") >= len(COLUMNS), F.get("_v", F.lit(0)).try_cast("int")
    word = F.coalesce(level == 5, F.lit(False))
    return _lines(tables, key, text).groupBy(key).agg(F.count_if(whole & word).alias("words"), F.count_if(whole & ~word).alias("other"), F.count_if(~whole & (F.trim("_line") != "")).alias("skipped"))
