"""Exact sums and rounding that do not depend on the order of the rows.

Durations carry one decimal and money two, so they are summed as whole tenths and cents.
One division follows the sum, and half-way cases are rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(column: str | Column) -> Column:
    return F.round(_col(column) * 10.0).cast("bigint")


def cents(column: str | Column) -> Column:
    return F.round(_col(column) * 100.0).cast("bigint")


def half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in doubles; missing where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def mean_of_tenths(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count.cast("double") * 10.0)


def amount(total_cents: Column) -> Column:
    return total_cents.cast("double") / 100.0


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
