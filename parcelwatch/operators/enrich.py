"""The three enrichments: orders, order items and order reviews.

No join here carries a broadcast hint. Spark broadcasts a side only when its measured size
is under `spark.sql.autoBroadcastJoinThreshold`, and otherwise shuffles both sides and lets
adaptive execution split hot keys, so nothing breaks when a lookup table grows.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwatch.functions import clocks, texts
from parcelwatch.params import Params
from parcelwatch.schemas import ORDER_ITEMS, ORDER_REVIEWS, ORDERS, RAW


def enrich_orders(orders: DataFrame, params: Params = Params()) -> DataFrame:
    """Stage durations, the late flag and the purchase period of each order."""
    return orders.withColumns(
        {
            **clocks.durations(),
            "is_late": clocks.late_flag(params.delivered),
            "order_month": clocks.purchase_month(),
            "order_year": clocks.purchase_year(),
        }
    ).select(*ORDERS)


def order_context(
    orders: DataFrame, customers: DataFrame, columns: Collection[str] = ORDER_ITEMS
) -> DataFrame:
    """What an item takes from its order and the order's customer, one row per order."""
    own = [c for c in ("order_status", "order_purchase_timestamp") if c in columns]
    place = [c for c in ("customer_state", "customer_city") if c in columns]
    context = orders.select("order_id", "customer_id", *own)
    if place:
        context = context.join(customers.select("customer_id", *place), "customer_id", "left")
    return context


def with_category(df: DataFrame, translation: DataFrame) -> DataFrame:
    """Replace the product category name by its label, translated where possible."""
    label = texts.category_label(
        F.col("product_category_name_english"), F.col("product_category_name")
    )
    return (
        df.join(translation, "product_category_name", "left")
        .withColumn("category", label)
        .drop("product_category_name", "product_category_name_english")
    )


def enrich_items(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    columns: Collection[str] = ORDER_ITEMS,
) -> DataFrame:
    """Items with the places of seller and customer, the category and the route flag.

    Customers are joined to orders first, so the item table, the largest one, is not
    shuffled by customer. The other lookups are plain scans, whose size Spark knows: a small
    one is broadcast from the start. Products, the largest, take their labels first, so items are
    never shuffled by the few names of categories, and are joined before the order, whose columns
    would travel with the items. Only the joins that the wanted `columns` need are made.
    """
    wanted = set(columns)
    needed = set(wanted)
    if "is_same_state" in wanted:
        needed |= {"seller_state", "customer_state"}

    seller_place = [c for c in ("seller_state", "seller_city") if c in needed]
    from_order = needed & set(ORDER_ITEMS) - set(RAW["order_items"]) - {
        "category",
        "is_same_state",
        *seller_place,
    }

    df = items.select([c for c in RAW["order_items"] if c in needed | _join_keys(needed)])
    if "category" in needed:
        names = products.select("product_id", "product_category_name")
        df = df.join(with_category(names, translation), "product_id", "left")
        df = df.withColumn("category", _label())
    if from_order:
        df = df.join(order_context(orders, customers, needed), "order_id", "left")
    if seller_place:
        df = df.join(sellers.select("seller_id", *seller_place), "seller_id", "left")
    if "is_same_state" in wanted:
        df = df.withColumn("is_same_state", _same_state())
    return df.select([c for c in ORDER_ITEMS if c in wanted])


def _label() -> Column:
    """The label of an item whose product is not listed is the one of a missing name."""
    return F.coalesce("category", texts.category_label(F.lit(None), F.lit(None)))


def _same_state() -> Column:
    same = F.col("seller_state") == F.col("customer_state")
    return F.coalesce(same, F.lit(False)).cast("int")


def _join_keys(needed: Collection[str]) -> set[str]:
    keys = {"order_id"}
    if {"seller_state", "seller_city"} & set(needed):
        keys.add("seller_id")
    if "category" in needed:
        keys.add("product_id")
    return keys


# --- repeated lookup keys -------------------------------------------------------------------

#: Different rows of a repeated key that travel in one array; a key with more is several arrays.
IN_ARRAY = 16


def _arrays(lookup: DataFrame, key: str, columns: Collection[str], name: str) -> DataFrame:
    """The rows of each key as arrays, equal ones as one with their number; a missing key joins nothing."""
    known = lookup.filter(F.col(key).isNotNull()).groupBy(key, *columns).agg(F.count(F.lit(1)).alias("copies"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*columns))
    parts = known.withColumn("part", F.floor((place - 1) / IN_ARRAY)).groupBy(key, "part")
    return parts.agg(F.collect_list(F.struct(*columns, "copies")).alias(name)).drop("part")


def pack_items(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    repeated: Collection[str],
) -> DataFrame:
    """Items beside arrays of what they look up in tables with `repeated` keys.

    `unpack_items` makes the rows of `enrich_items` of them. A customer that is there twice and a
    seller that is there three times make six rows of an item: this is left for when it has travelled.
    """
    own, place = ("order_status", "order_purchase_timestamp"), ("customer_state", "customer_city")
    df = items.select(*RAW["order_items"])
    names = products.select("product_id", "product_category_name")
    if {"products", "category_translation"} & set(repeated):
        df = df.join(_arrays(with_category(names, translation), "product_id", ("category",), "products"), "product_id", "left")
    else:
        df = df.join(with_category(names, translation), "product_id", "left")
    seller_place = ("seller_state", "seller_city")
    if "sellers" in repeated:
        sellers = _arrays(sellers, "seller_id", seller_place, "sellers")
    else:
        sellers = sellers.select("seller_id", *seller_place)
    if "customers" in repeated:
        context = order_context(orders, customers, own)
        context = context.join(_arrays(customers, "customer_id", place, "customers"), "customer_id", "left")
    else:
        context = order_context(orders, customers, (*own, *place))
    return df.join(context, "order_id", "left").join(sellers, "seller_id", "left")


def unpack_items(packed: DataFrame) -> DataFrame:
    df = packed
    for name in ("products", "customers", "sellers"):
        if name in packed.columns:  # nothing found: one row of missing values
            df = df.select("*", F.inline_outer(name)).drop(name)
            copies = F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))
            df = df.withColumn("copy", F.explode(copies)).drop("copies", "copy")
    return df.withColumns({"category": _label(), "is_same_state": _same_state()}).select(*ORDER_ITEMS)


# What a review takes from its order.
DELIVERY_CONTEXT = (
    "order_status",
    "total_delivery_days",
    "estimated_days",
    "delay_days",
    "is_late",
    "seller_processing_days",
    "carrier_delivery_days",
    "order_month",
)


def enrich_reviews(
    reviews: DataFrame, enriched_orders: DataFrame, params: Params = Params()
) -> DataFrame:
    """Reviews with the delivery context of their order and the two complaint flags."""
    df = reviews.join(enriched_orders.select("order_id", *DELIVERY_CONTEXT), "order_id", "left")
    complaint = (F.col("review_score") <= params.complaint_max_score) & (F.col("is_late") == 1)
    return df.withColumns(
        {
            "is_delivery_complaint": F.coalesce(complaint, F.lit(False)).cast("int"),
            "comment_has_delay_keyword": texts.mentions(
                F.col("review_comment_message"), params.delay_keywords, params.whole_words
            ),
        }
    ).select(*ORDER_REVIEWS)
