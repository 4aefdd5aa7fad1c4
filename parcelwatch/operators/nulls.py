"""Null policy: what replaces a missing value in each curated table.

The values are part of the results: durations filled with 0.0 enter the averages.
`Params.impute_missing=False` leaves durations missing, so averages skip them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelwatch.params import Params

# Fills by table and column.
FILLS: dict[str, dict[str, object]] = {
    "orders": {
        "approval_time_hours": 0.0,
        "seller_processing_days": 0.0,
        "carrier_delivery_days": 0.0,
        "total_delivery_days": 0.0,
        "estimated_days": 0.0,
        "delay_days": 0.0,
        "is_late": 0,
        "order_approved_at": "",
        "order_delivered_carrier_date": "",
        "order_delivered_customer_date": "",
        "order_year": 0,
    },
    "order_items": {
        "seller_state": "unknown",
        "seller_city": "unknown",
        "customer_state": "unknown",
        "customer_city": "unknown",
        "category": "unknown",
    },
    "order_reviews": {
        "review_comment_title": "",
        "review_comment_message": "",
        "total_delivery_days": 0.0,
        "estimated_days": 0.0,
        "delay_days": 0.0,
        "is_late": 0,
        "seller_processing_days": 0.0,
        "carrier_delivery_days": 0.0,
        "order_month": "unknown",
        "order_status": "unknown",
        "is_delivery_complaint": 0,
        "comment_has_delay_keyword": 0,
    },
    "mql": {"origin": "unknown", "landing_page_id": ""},
    "closed_deals": {
        "business_segment": "unknown",
        "lead_type": "unknown",
        "lead_behaviour_profile": "unknown",
        "business_type": "unknown",
        "declared_product_catalog_size": 0.0,
        "declared_monthly_revenue": 0.0,
        "won_date": "",
    },
    "category_translation": {
        "product_category_name": "unknown",
        "product_category_name_english": "unknown",
    },
    "geolocation": {"geolocation_city": "unknown", "geolocation_state": "unknown"},
}

_DURATIONS = ("approval_time_hours", "estimated_days", "delay_days")


def _is_duration(column: str) -> bool:
    return column in _DURATIONS or column.endswith(("_processing_days", "_delivery_days"))


def fill_missing(table: str, df: DataFrame, params: Params = Params()) -> DataFrame:
    if table == "products":
        return fill_products(df)
    fills = {c: v for c, v in FILLS.get(table, {}).items() if c in df.columns}
    if not params.impute_missing:
        fills = {c: v for c, v in fills.items() if not _is_duration(c)}
    return df.fillna(fills) if fills else df


def fill_products(df: DataFrame) -> DataFrame:
    """Every text column becomes 'unknown' where missing, every number 0."""
    is_text = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema}
    return df.fillna({name: "unknown" if text else 0.0 for name, text in is_text.items()})
