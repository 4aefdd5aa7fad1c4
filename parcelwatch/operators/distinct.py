"""Distinct counts that can be added up later: orders as bits, merged by OR.

A plain distinct count per month and seller cannot be summed over months or sellers, as an order
may be in several groups. Orders get numbers, a group is kept as bitmaps of the numbers it holds,
and the bitmaps of any groups are merged with OR and counted. A bitmap covers a fixed range of
numbers (a bucket), so a group has a row for each bucket it has orders in. Numbers follow the keys
most groups are made of: orders of a month and seller are neighbours and share buckets, so a group
of n orders has about n / 64 rows, not one for each order. A bucket is one number of 64 bits: most
groups hold a handful of orders, and a wider bitmap would be mostly empty in each of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a bitmap covers: the bits of a bigint.
WIDTH = 64

#: What bitmaps are kept by; any of them, or none, can be merged to.
BITMAP_KEYS = ("order_month", "seller_state", "customer_state", "seller_id")


def number_orders(pairs: DataFrame, id_col: str, near: Sequence[str]) -> DataFrame:
    """`id_col` and its `number`, one row an id, ids with like `near` values next to each other.

    Numbers are taken from the place of a row in ranges of its keys. They differ from run to run:
    write them down before they are used twice.
    """
    lowest = [F.min(c).alias(c) for c in near]
    ids = pairs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*lowest)
    dealt = ids.repartitionByRange(*near, id_col).sortWithinPartitions(*near, id_col)
    return dealt.select(id_col, F.monotonically_increasing_id().alias("number"))


def order_bitmaps(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and bucket the bits of all orders and of the late ones.

    `numbered` has the keys, `number` and `late` (0 or 1, any of an order's rows).
    """
    bit = F.expr(f"shiftleft(1L, CAST(pmod(number, {WIDTH}) AS INT))")
    return numbered.groupBy(*keys, F.expr(f"number DIV {WIDTH}").alias("bucket")).agg(
        F.bit_or(bit).alias("orders"),
        F.bit_or(F.when(F.col("late") == 1, bit).otherwise(F.lit(0))).alias("late_orders"),
    )


def count_orders(bitmaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct orders, and late ones, of each group of some of the keys the bitmaps have."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(
        F.bit_or("orders").alias("orders"), F.bit_or("late_orders").alias("late_orders")
    )
    counts = [F.sum(F.bit_count(c)).cast("bigint").alias(c) for c in ("orders", "late_orders")]
    return merged.groupBy(*keys).agg(*counts)
