"""Measures of a group set against all groups: shares of a total and gaps to a mean.

The totals are a scalar subquery over the grouped rows, not a window without partitions:
a window would move every group to one task. Spark reuses the exchange below the grouping
for both, so the facts are scanned and joined once; for that the subquery reads every
measure of `grouped`, and `grouped` should carry only measures the caller uses.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.functions.numbers import percent


# Twelve decimals: beyond what a rounded report shows, and exact to add up.
FIXED = "decimal(38, 12)"


def _mean(value: Column) -> Column:
    """A mean that does not depend on the order of the rows: doubles are added as decimals."""
    total = F.sum(value.cast(FIXED)).cast("double")
    return F.try_divide(total, F.count(value).cast("double"))


class Totals:
    """Totals over all rows of `grouped`: sums of `measures`, means of `means`."""

    def __init__(
        self,
        grouped: DataFrame,
        measures: tuple[str, ...],
        means: Mapping[str, Column] | None = None,
    ):
        fields = [F.sum(m).alias(f"sum_{m}") for m in measures]
        fields += [_mean(value).alias(f"mean_{name}") for name, value in (means or {}).items()]
        self._row = grouped.agg(F.struct(*fields).alias("totals")).scalar()

    def total(self, measure: str) -> Column:
        return self._row.getField(f"sum_{measure}")

    def mean(self, name: str) -> Column:
        return self._row.getField(f"mean_{name}")

    def share(self, measure: str) -> Column:
        """The group's percentage of the total; missing where the total is zero."""
        return percent(F.col(measure), self.total(measure))
