"""Timestamps and the durations of the delivery stages.

Text is parsed without a time zone, so durations do not shift where clocks change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400

PURCHASED = "order_purchase_timestamp"
APPROVED = "order_approved_at"
HANDED_OVER = "order_delivered_carrier_date"
ARRIVED = "order_delivered_customer_date"
PROMISED = "order_estimated_delivery_date"

# duration: (from, to, unit in seconds)
DURATIONS = {
    "approval_time_hours": (PURCHASED, APPROVED, HOUR),
    "seller_processing_days": (APPROVED, HANDED_OVER, DAY),
    "carrier_delivery_days": (HANDED_OVER, ARRIVED, DAY),
    "total_delivery_days": (PURCHASED, ARRIVED, DAY),
    "estimated_days": (PURCHASED, PROMISED, DAY),
}


def moment(column: str) -> Column:
    """Text to timestamp; empty or malformed text is missing."""
    return F.col(column).try_cast("timestamp_ntz")


def elapsed(start: str, end: str, unit: int) -> Column:
    seconds = F.unix_timestamp(moment(end)) - F.unix_timestamp(moment(start))
    return F.round(seconds / F.lit(unit), 1)


def durations() -> dict[str, Column]:
    """All stage durations. The delay is the difference of the rounded values."""
    columns = {name: elapsed(*rule) for name, rule in DURATIONS.items()}
    columns["delay_days"] = F.round(columns["total_delivery_days"] - columns["estimated_days"], 1)
    return columns


def late_flag(delivered: str) -> Column:
    """1 for a delivered order that arrived after the promised moment, else 0."""
    late = (F.col("order_status") == delivered) & (moment(ARRIVED) > moment(PROMISED))
    return F.coalesce(late, F.lit(False)).cast("int")


def purchase_month() -> Column:
    return F.date_format(moment(PURCHASED), "yyyy-MM")


def purchase_year() -> Column:
    return F.year(moment(PURCHASED))
