"""Enrichment, null policy and deduplication on hand-written rows."""

from __future__ import annotations

import pytest
from helpers import item, order, raw_table, raw_tables, review, rows

from parcelwatch.operators.dedup import one_per_key
from parcelwatch.operators.nulls import fill_missing
from parcelwatch.params import Params
from parcelwatch.plans.curated import curate
from parcelwatch.schemas import TABLES, curated_columns

MISSING = (None, None, None, None, None)


@pytest.fixture(scope="module")
def market(spark):
    return raw_tables(
        spark,
        orders=[order("a"), order("b", "canceled", (0, None, None, None, 10), "nobody")],
        order_items=[
            item("a", "s1", product="p1"),
            item("a", "s2", product="p2", number=2),
            item("b", "s9", product="p9"),
            item("zzz", "s1", product="p3"),
        ],
        order_reviews=[
            review("a", 2, "demorou", "r1"),
            review("b", 1, None, "r2"),
            review("zzz", 1, "late", "r3"),
        ],
        customers=[{"customer_id": "c1", "customer_state": "SP", "customer_city": "x"}],
        sellers=[
            {"seller_id": "s1", "seller_state": "SP", "seller_city": "u"},
            {"seller_id": "s2", "seller_state": "RJ", "seller_city": None},
        ],
        products=[
            {"product_id": "p1", "product_category_name": "brinquedos"},
            {"product_id": "p2", "product_category_name": "raro"},
            {"product_id": "p3"},
        ],
        category_translation=[
            {"product_category_name": "brinquedos", "product_category_name_english": "toys"},
            {"product_category_name": None, "product_category_name_english": "never"},
        ],
    )


def by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_orders_are_filled(market):
    filled = by(curate(market, "orders"), "order_id")[("b",)]
    assert filled.seller_processing_days == 0.0
    assert filled.total_delivery_days == 0.0
    assert filled.estimated_days == 10.0
    assert filled.order_approved_at == ""
    assert filled.is_late == 0


def test_orders_without_imputation_keep_missing_durations(market):
    df = curate(market, "orders", Params(impute_missing=False))
    kept = by(df, "order_id")[("b",)]
    assert kept.seller_processing_days is None
    assert kept.order_approved_at == ""


def test_purchase_promise_and_month_are_not_filled(spark):
    raw = raw_tables(spark, orders=[{"order_id": "a", "order_status": "created"}])
    (row,) = curate(raw, "orders").collect()
    assert row.order_purchase_timestamp is None
    assert row.order_estimated_delivery_date is None
    assert row.order_month is None
    assert row.order_year == 0


def test_items_take_places_and_category(market):
    items = by(curate(market, "order_items"), "order_id", "order_item_id")
    first, second = items[("a", 1)], items[("a", 2)]
    assert (first.category, first.is_same_state, first.seller_city) == ("toys", 1, "u")
    assert (second.category, second.is_same_state) == ("raro", 0)
    assert second.seller_city == "unknown"


def test_unmatched_items_are_kept_as_unknown(market):
    items = by(curate(market, "order_items"), "order_id", "order_item_id")
    stray = items[("b", 1)]
    assert (stray.seller_state, stray.customer_state, stray.category) == ("unknown",) * 3
    assert stray.is_same_state == 0  # two unknown states are not the same state
    assert stray.order_status == "canceled"
    no_order = items[("zzz", 1)]
    assert (no_order.customer_id, no_order.order_status) == (None, None)
    assert no_order.category == "unknown"
    assert len(items) == 4


@pytest.mark.parametrize(
    "columns",
    [
        ("order_id",),
        ("order_id", "seller_state"),
        ("order_id", "customer_state", "price"),
        ("category", "order_status"),
        ("is_same_state",),
        ("order_id", "customer_id"),
    ],
)
def test_a_choice_of_columns_gives_the_same_values(market, columns):
    some = curate(market, "order_items", columns=columns)
    everything = curate(market, "order_items").select(*columns)
    assert some.columns == list(columns)
    assert sorted(map(str, rows(some))) == sorted(map(str, rows(everything)))


def test_reviews_take_delivery_context(spark):
    raw = raw_tables(
        spark,
        orders=[order("late", days=(0, 0, 1, 20, 10)), order("fine")],
        order_reviews=[
            review("late", 2, "x", "r2"),
            review("late", 3, "x", "r3"),
            review("fine", 1, "Tudo tarde", "r1"),
        ],
    )
    reviews = by(curate(raw, "order_reviews"), "review_id")
    assert [reviews[(r,)].is_delivery_complaint for r in ("r2", "r3", "r1")] == [1, 0, 0]
    assert [reviews[(r,)].comment_has_delay_keyword for r in ("r2", "r3", "r1")] == [0, 0, 1]
    assert reviews[("r2",)].delay_days == 10.0


def test_unmatched_reviews_are_filled(market):
    stray = by(curate(market, "order_reviews"), "review_id")[("r3",)]
    assert (stray.order_status, stray.order_month) == ("unknown", "unknown")
    assert (stray.is_late, stray.is_delivery_complaint, stray.delay_days) == (0, 0, 0.0)
    assert stray.comment_has_delay_keyword == 1
    assert stray.review_comment_title == ""


def test_reviews_without_imputation(market):
    df = curate(market, "order_reviews", Params(impute_missing=False))
    stray = by(df, "review_id")[("r3",)]
    assert (stray.delay_days, stray.is_late) == (None, 0)


@pytest.mark.parametrize(
    ("table", "row", "want"),
    [
        ("products", MISSING, ("unknown", "unknown", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
        ("mql", MISSING, (None, None, "", "unknown")),
        (
            "closed_deals",
            MISSING,
            (None, None, "", "unknown", "unknown", "unknown", "unknown", 0.0, 0.0),
        ),
        ("category_translation", MISSING, ("unknown", "unknown")),
        ("geolocation", MISSING, (None, None, None, "unknown", "unknown")),
        ("order_payments", MISSING, (None,) * 5),
        ("customers", MISSING, (None,) * 5),
        ("sellers", MISSING, (None,) * 4),
    ],
)
def test_null_policy_of_a_row_without_values(spark, table, row, want):
    df = raw_table(spark, table, [{}])
    assert rows(fill_missing(table, df)) == [want]


def test_curated_columns(spark):
    raw = raw_tables(spark)
    for table in TABLES:
        df = curate(raw, table)
        assert tuple(df.columns) == curated_columns(table)
        assert df.count() == 0


def test_one_location_per_prefix(spark):
    zips = [
        {"geolocation_zip_code_prefix": 1, "geolocation_lat": 2.0, "geolocation_city": "b"},
        {"geolocation_zip_code_prefix": 1, "geolocation_lat": 1.0, "geolocation_city": "z"},
        {"geolocation_zip_code_prefix": 1, "geolocation_lat": 1.0, "geolocation_city": "a"},
        {"geolocation_zip_code_prefix": 2, "geolocation_lat": 1.0},
        {"geolocation_zip_code_prefix": None, "geolocation_lat": 5.0},
    ]
    df = raw_table(spark, "geolocation", zips)
    kept = one_per_key(df, "geolocation_zip_code_prefix")
    assert kept.columns == df.columns
    picked = {(r[0], r[1], r[3]) for r in kept.collect()}
    assert picked == {(1, 1.0, "a"), (2, 1.0, None), (None, 5.0, None)}
    shuffled = one_per_key(df.repartition(5), "geolocation_zip_code_prefix")
    assert sorted(map(str, rows(shuffled))) == sorted(map(str, rows(kept)))
