"""Quantiles that can be merged later: one sketch a group, of a bounded size.

Exact quantiles of several months need all their values again. A KLL sketch keeps a sample that
shrinks as it grows, from which any quantile is read with a bounded error in rank; sketches of
parts merge to a sketch of the whole. Values are whole tenths of a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.functions.numbers import tenths

#: Size of a sketch, and the error in rank promised with it. The usual error of this size is
#: 0.6 % with 99 % confidence; three times that leaves no doubt.
SKETCH_SIZE = 800
RANK_ERROR = 0.02


#: The two stages that are compared.
STAGE_PAIR = ("seller_processing_days", "carrier_delivery_days")


def stage_values(orders: DataFrame, delivered: str, *keys: str) -> DataFrame:
    """(keys, component, tenths) of each delivered order; imputed zeros and negatives drop out."""
    pairs = [part for stage in STAGE_PAIR for part in (F.lit(stage), tenths(stage))]
    return (
        orders.filter(F.col("order_status") == delivered)
        .select(*keys, F.stack(F.lit(len(STAGE_PAIR)), *pairs).alias("component", "tenths"))
        .filter(F.col("tenths") > 0)
    )


def stage_sketches(orders: DataFrame, delivered: str) -> DataFrame:
    """A mergeable sketch of each stage and month: (order_month, component, sketch)."""
    return sketch_of(stage_values(orders, delivered, "order_month"), ("order_month", "component"), "tenths")


def sketch_of(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`sketch` of the values of each group."""
    return values.groupBy(*keys).agg(F.kll_sketch_agg_bigint(value, SKETCH_SIZE).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of the groups of some of their keys; `n` values."""
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return whole.withColumn("n", F.kll_sketch_get_n_bigint("sketch"))


def quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))


def rank_check(values: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame, error: float) -> DataFrame:
    """Whether estimated quantiles lie where they promise to.

    `estimates` has the keys, `q` and `estimate`. The ranks of an estimate are the share of values
    below it and the share up to it; `within` says whether these come within `error` of `q`.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    both = estimates.join(counts, list(keys))
    number = F.col("k")
    ranks = both.groupBy(*keys, "q", "estimate").agg(
        F.sum(F.when(F.col(value) < F.col("estimate"), number).otherwise(0)).alias("below"),
        F.sum(F.when(F.col(value) <= F.col("estimate"), number).otherwise(0)).alias("upto"),
        F.sum(number).alias("n"),
    )
    low = F.col("below") / F.col("n") <= F.col("q") + error
    high = F.col("upto") / F.col("n") >= F.col("q") - error
    return ranks.select(*keys, "q", "n", (low & high).alias("within"))
