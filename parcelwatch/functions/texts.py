"""Names and review texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(name) for name in df.columns])


def mentions(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """1 where the text holds a keyword in any case, else 0; missing text gives 0.

    Keywords are found inside other words too unless `whole_words` is set.
    """
    pattern = "|".join(keywords)
    if whole_words:
        pattern = rf"\b(?:{pattern})\b"
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False)).cast("int")


def category_label(english: Column, original: Column) -> Column:
    return F.coalesce(english, original, F.lit("unknown"))
