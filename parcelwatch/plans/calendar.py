"""A calendar of months, to choose published folders by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every month from `first` to `last` (yyyy-MM): order_month, year, quarter, month."""
    bounds = [F.to_date(F.lit(m), "yyyy-MM") for m in (first, last)]
    days = spark.range(1).select(F.explode(F.sequence(*bounds, F.expr("INTERVAL 1 MONTH"))).alias("day"))
    return days.select(
        F.date_format("day", "yyyy-MM").alias("order_month"),
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
    )
