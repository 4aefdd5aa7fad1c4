"""Orders x items x reviews without the many-to-many join.

An order with 3 items and 2 reviews gives 6 joined rows, and the published measures count
each of them. Every factor is first reduced to one row per order (items: per order and
group), with counts and sums. Joined on the order, the products of those sums and counts
are exactly the sums over the multiplied rows:

    rows          = items * copies of the order * max(reviews, 1)
    sum of x      = sum over the factor that holds x * counts of the other two
    avg of score  = sum of scores / number of scores, both times items and copies

An order that is in the table twice counts twice in the sums and once in the distinct
counts, as it would in the literal join.

Scale: items are combined on the map side before their first shuffle, so an order or seller
that holds a large part of the rows does not travel row by row. All factors meet on the
order, and the grouping by order needs no further shuffle. It leaves one row per order and
group, so distinct orders are a plain count without Expand. The last grouping combines on
the map side too: a hot seller or state is never one task's work.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.functions.numbers import cents, tenths

STAGES = ("seller_processing_days", "carrier_delivery_days", "total_delivery_days")
ITEM_KEYS = ("seller_id", "seller_state", "seller_city", "customer_state")


def item_facts(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of one order within one group: how many, price and freight in cents."""
    return items.groupBy("order_id", *keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(cents("price")).alias("price"),
        F.sum(cents("freight_value")).alias("freight"),
    )


def order_facts(orders: DataFrame) -> DataFrame:
    """One row per order (and status): copies, late copies, stages in tenths of a day."""
    processed = F.col("seller_processing_days") >= 0
    # orders are near-unique: one shuffle by the order serves the grouping and the joins
    return orders.repartition("order_id").groupBy("order_id", "order_status", processed.alias("processed")).agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.sum("is_late").alias("late_copies"),
        F.max("is_late").alias("late"),
        *[F.sum(tenths(c)).alias(f"{c}_sum") for c in STAGES],
        *[F.max(tenths(c)).alias(f"{c}_once") for c in STAGES],
        *[F.count(c).alias(f"{c}_count") for c in STAGES],
    )


def review_facts(reviews: DataFrame) -> DataFrame:
    """One row per reviewed order: number of reviews, scores and one-star reviews."""
    score = F.col("review_score")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(score).alias("n_scores"),
        F.sum(score).alias("scored"),
        F.count_if(score == 1).alias("n_one_star"),
    )


def delivery_facts(
    items: DataFrame, orders: DataFrame, reviews: DataFrame, keys: Sequence[str] = ITEM_KEYS
) -> DataFrame:
    """The three factors side by side, one row per order and item group.

    Every report over orders and items can be computed from it; published once per refresh,
    it saves them the joins.
    """
    return (
        item_facts(items, keys)
        .join(order_facts(orders), "order_id")
        .join(review_facts(reviews), "order_id", "left")
    )


def order_groups(
    facts: DataFrame, keys: Sequence[str], reviews: bool = True, per_order: bool = False
) -> DataFrame:
    """One row per order and group with measures that only need to be summed.

    `reviews` multiplies the rows by the order's reviews, as a join with them would.
    `per_order` counts each order once per group and each item once, instead of once per
    joined row.
    """
    columns = counted(reviews, per_order)
    late = F.max("late").alias("late_orders")
    return facts.groupBy("order_id", *keys).agg(late, *[v.alias(k) for k, v in columns.items()])


def counted(reviews: bool = True, per_order: bool = False) -> dict[str, Column]:
    """The measures of an order within a group, as aggregates over its facts."""
    return _once() if per_order else _weighted(reviews)


def _weighted(reviews: bool) -> dict[str, Column]:
    n_items, copies, late = F.col("n_items"), F.col("n_copies"), F.col("late_copies")
    fan = F.coalesce("n_reviews", F.lit(1)) if reviews else F.lit(1)
    columns = {
        "rows": F.sum(n_items * copies * fan),
        "late_rows": F.sum(n_items * late * fan),
        "price_cents": F.sum(F.col("price") * copies * fan),
        "freight_cents": F.sum(F.col("freight") * copies * fan),
        "late_freight_cents": F.sum(F.coalesce("freight", F.lit(0)) * late * fan),
        "score_sum": F.sum(n_items * copies * F.col("scored")),
        "scores": F.sum(n_items * copies * F.col("n_scores")),
        "one_star": F.sum(n_items * copies * F.col("n_one_star")),
    }
    for stage in STAGES:
        columns[f"{stage}_tenths"] = F.sum(n_items * F.col(f"{stage}_sum") * fan)
        columns[f"{stage}_n"] = F.sum(n_items * F.col(f"{stage}_count") * fan)
    return columns


def _once() -> dict[str, Column]:
    columns = {
        "rows": F.max(F.lit(1)),
        "late_rows": F.max("late"),
        "price_cents": F.sum("price"),
        "freight_cents": F.sum("freight"),
        "late_freight_cents": F.sum(F.coalesce("freight", F.lit(0)) * F.col("late")),
        "score_sum": F.max("scored"),
        "scores": F.max("n_scores"),
        "one_star": F.max("n_one_star"),
    }
    for stage in STAGES:
        columns[f"{stage}_tenths"] = F.max(f"{stage}_once")
        columns[f"{stage}_n"] = F.max(F.least(f"{stage}_count", F.lit(1)))
    return columns


def group_measures(groups: DataFrame, keys: Sequence[str], measures: Iterable[str]) -> DataFrame:
    """Sums of the named measures per group; `orders` counts the distinct orders."""
    summed = {m: F.sum(m) for m in measures}
    if "orders" in summed:
        summed["orders"] = F.count("order_id")
    for name in summed:  # no review at all is a count of zero
        if name.endswith(("scores", "one_star")):
            summed[name] = F.coalesce(summed[name], F.lit(0))
    columns = [v.cast("bigint").alias(k) for k, v in summed.items()]
    return groups.groupBy(*keys).agg(*columns)
