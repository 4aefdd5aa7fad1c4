"""Tables of the marketplace: raw columns with types, sort keys of the curated tables."""

from __future__ import annotations

# Raw tables as they arrive, after header normalisation. Timestamps stay text until they
# are enriched. File, column and type names, misspellings included.
RAW = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "string",
        "order_approved_at": "string",
        "order_delivered_carrier_date": "string",
        "order_delivered_customer_date": "string",
        "order_estimated_delivery_date": "string",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "string",
        "price": "double",
        "freight_value": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "double",
    },
    "order_reviews": {
        "review_id": "string",
        "order_id": "string",
        "review_score": "int",
        "review_comment_title": "string",
        "review_comment_message": "string",
        "review_creation_date": "string",
        "review_answer_timestamp": "string",
    },
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "int",
        "customer_city": "string",
        "customer_state": "string",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_name_lenght": "double",
        "product_description_lenght": "double",
        "product_photos_qty": "double",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "int",
        "seller_city": "string",
        "seller_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "int",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
    "mql": {
        "mql_id": "string",
        "first_contact_date": "string",
        "landing_page_id": "string",
        "origin": "string",
    },
    "closed_deals": {
        "mql_id": "string",
        "seller_id": "string",
        "won_date": "string",
        "business_segment": "string",
        "lead_type": "string",
        "lead_behaviour_profile": "string",
        "business_type": "string",
        "declared_product_catalog_size": "double",
        "declared_monthly_revenue": "double",
    },
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

TABLES = tuple(RAW)

# Columns the enrichments add, with types.
DELIVERY = {
    "approval_time_hours": "double",
    "seller_processing_days": "double",
    "carrier_delivery_days": "double",
    "total_delivery_days": "double",
    "estimated_days": "double",
    "delay_days": "double",
    "is_late": "int",
    "order_month": "string",
    "order_year": "int",
}
COMPLAINT = {"is_delivery_complaint": "int", "comment_has_delay_keyword": "int"}
LOOKUPS = {
    "category": "string",
    "seller_state": "string",
    "seller_city": "string",
    "customer_id": "string",
    "customer_state": "string",
    "customer_city": "string",
    "order_status": "string",
    "is_same_state": "int",
    "order_purchase_timestamp": "string",
}

# Curated columns in their published order, where they differ from the raw ones.
ORDERS = (*RAW["orders"], *DELIVERY)
ORDER_ITEMS = (
    "order_id",
    "order_item_id",
    "product_id",
    "category",
    "seller_id",
    "seller_state",
    "seller_city",
    "customer_id",
    "customer_state",
    "customer_city",
    "order_status",
    "price",
    "freight_value",
    "shipping_limit_date",
    "is_same_state",
    "order_purchase_timestamp",
)
ORDER_REVIEWS = (
    *RAW["order_reviews"],
    "order_status",
    "total_delivery_days",
    "estimated_days",
    "delay_days",
    "is_late",
    "seller_processing_days",
    "carrier_delivery_days",
    "order_month",
    "is_delivery_complaint",
    "comment_has_delay_keyword",
)

# Order of the rows inside each published file.
SORT_KEYS = {
    "orders": ("order_month", "order_id"),
    "order_items": ("seller_id", "order_id"),
    "order_reviews": ("order_month", "review_score"),
    "order_payments": ("order_id", "payment_sequential"),
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "mql": ("mql_id",),
    "closed_deals": ("mql_id",),
    "category_translation": ("product_category_name",),
    "geolocation": ("geolocation_state", "geolocation_zip_code_prefix"),
}

# Folders inside a published table: a filter on the column, or a join with one, skips them.
PARTITIONS = {"orders": ("order_month",), "order_reviews": ("order_month",)}

# Columns that rows are looked up by although the files are not sorted by them.
LOOKUP_COLUMNS = {
    "orders": ("order_id", "customer_id"),
    "order_items": ("order_id", "customer_id"),
    "order_reviews": ("order_id",),
}

# Tables joined by a key that is taken to be unique: a repeated key multiplies rows.
LOOKUP_KEYS = {
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "category_translation": "product_category_name",
}


def curated_columns(table: str) -> tuple[str, ...]:
    enriched = {"orders": ORDERS, "order_items": ORDER_ITEMS, "order_reviews": ORDER_REVIEWS}
    return enriched.get(table, tuple(RAW[table]))


def raw_schema(table: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in RAW[table].items())


def curated_schema(table: str) -> str:
    types = {**DELIVERY, **COMPLAINT, **LOOKUPS, **RAW[table]}
    return ", ".join(f"{name} {types[name]}" for name in curated_columns(table))
