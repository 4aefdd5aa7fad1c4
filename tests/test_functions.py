"""Expressions on hand-written values."""

from __future__ import annotations

import pytest
from helpers import column, order, raw_table, rows
from pyspark.sql import functions as F

from parcelwatch.functions import bands, texts
from parcelwatch.functions.numbers import half_up, percent, ratio
from parcelwatch.operators.enrich import enrich_orders
from parcelwatch.params import Params

P = Params()


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


# --- clocks ---


def enriched(spark, *orders):
    return enrich_orders(raw_table(spark, "orders", orders)).collect()


def test_durations_and_delay(spark):
    (row,) = enriched(spark, order("a", days=(0, 1, 3, 13, 10)))
    assert row.approval_time_hours == 24.0
    assert row.seller_processing_days == 2.0
    assert row.carrier_delivery_days == 10.0
    assert row.total_delivery_days == 13.0
    assert row.estimated_days == 10.0
    assert row.delay_days == 3.0
    assert row.is_late == 1
    assert (row.order_month, row.order_year) == ("2018-01", 2018)


@pytest.mark.parametrize("text", ["", "soon", "2018-13-45 00:00:00", None])
def test_unreadable_moments_are_missing(spark, text):
    broken = {**order("a"), "order_delivered_customer_date": text}
    (row,) = enriched(spark, broken)
    assert row.total_delivery_days is None
    assert row.carrier_delivery_days is None
    assert row.estimated_days == 10.0
    assert row.is_late == 0
    assert row.order_delivered_customer_date == text


def test_unreadable_purchase_has_no_month(spark):
    (row,) = enriched(spark, {**order("a"), "order_purchase_timestamp": ""})
    assert (row.order_month, row.order_year) == (None, None)


def test_only_delivered_orders_are_late(spark):
    late = (0, 0, 1, 20, 10)
    flags = enriched(spark, order("a", "delivered", late), order("b", "shipped", late))
    assert [r.is_late for r in flags] == [1, 0]


def test_flag_uses_moments_and_delay_uses_rounded_days(spark):
    slightly = {**order("a"), "order_delivered_customer_date": "2018-01-11 00:30:00"}
    (row,) = enriched(spark, slightly)
    assert (row.is_late, row.delay_days) == (1, 0.0)


def test_on_the_promised_moment_is_not_late(spark):
    (row,) = enriched(spark, order("a", days=(0, 0, 1, 10, 10)))
    assert row.is_late == 0


def test_negative_durations_are_kept(spark):
    (row,) = enriched(spark, order("a", days=(3, 5, 3, 9, 10)))
    assert row.seller_processing_days == -2.0


def test_durations_do_not_depend_on_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="America/Sao_Paulo")
    across = {
        **order("a"),
        "order_purchase_timestamp": "2018-11-03 12:00:00",  # clocks change in between
        "order_delivered_customer_date": "2018-11-04 12:00:00",
    }
    (row,) = enriched(spark, across)
    assert row.total_delivery_days == 1.0


# --- numbers ---


@pytest.mark.parametrize(
    ("value", "digits", "want"),
    [(2.25, 1, 2.3), (2.24, 1, 2.2), (-0.25, 1, -0.2), (12.5, 0, 13.0), (0.125, 2, 0.13)],
)
def test_half_up(spark, value, digits, want):
    assert one(spark, half_up(F.lit(value), digits)) == want


def test_division_by_zero_is_missing(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(4))) == 25.0


# --- texts ---


def test_header_normalisation(spark):
    df = spark.createDataFrame([(1, 2)], [" Order ID ", "PRICE"])
    assert texts.normalise_columns(df).columns == ["order_id", "price"]


@pytest.mark.parametrize(
    ("text", "inside", "whole"),
    [
        ("Chegou com ATRASO", 1, 1),
        ("Boa tarde", 1, 1),
        ("Great chocolate", 1, 0),  # holds 'late'
        ("It NEVER ARRIVED!", 1, 1),
        ("all fine", 0, 0),
        ("", 0, 0),
        (None, 0, 0),
    ],
)
def test_delay_keywords(spark, text, inside, whole):
    message = F.lit(text).cast("string")
    assert one(spark, texts.mentions(message, P.delay_keywords)) == inside
    assert one(spark, texts.mentions(message, P.delay_keywords, whole_words=True)) == whole


@pytest.mark.parametrize(
    ("english", "original", "want"),
    [("toys", "brinquedos", "toys"), (None, "brinquedos", "brinquedos"), (None, None, "unknown")],
)
def test_category_label(spark, english, original, want):
    label = texts.category_label(F.lit(english).cast("string"), F.lit(original).cast("string"))
    assert one(spark, label) == want


# --- bands ---


@pytest.mark.parametrize(
    ("days", "want"),
    [
        (1.0, "Fast"),
        (1.01, "Normal"),
        (3.0, "Normal"),
        (3.01, "Slow"),
        (7.0, "Slow"),
        (7.01, "Critical"),
        (-1.0, "Fast"),
        (None, "Critical"),
    ],
)
def test_sla_band(spark, days, want):
    value = F.lit(days).cast("double")
    assert one(spark, bands.sla(value, P)) == want
    assert one(spark, bands.sla(value, P, bands.SLA_RANGES)).startswith(want)


@pytest.mark.parametrize(
    ("orders", "want"),
    [(500, "High Volume"), (499, "Medium Volume"), (100, "Medium Volume"), (99, "Low Volume")],
)
def test_volume_band(spark, orders, want):
    assert one(spark, bands.volume(F.lit(orders), P)) == want


@pytest.mark.parametrize(
    ("amount", "want"),
    [
        (5000.01, "Besar (>5000)"),
        (5000.0, "Sedang (1000-5000)"),
        (1000.01, "Sedang (1000-5000)"),
        (1000.0, "Kecil (<1000)"),
        (None, "Kecil (<1000)"),
    ],
)
def test_loss_band(spark, amount, want):
    assert one(spark, bands.freight_loss(F.lit(amount).cast("double"), P)) == want


@pytest.mark.parametrize(
    ("days", "late", "want"),
    [
        (7.1, 30.1, "Intervensi Segera"),
        (7.0, 30.1, "Perlu Monitoring"),
        (7.1, 30.0, "Perlu Monitoring"),
        (3.1, 20.1, "Perlu Monitoring"),
        (3.0, 20.1, "Pantau Berkala"),
        (3.1, 20.0, "Pantau Berkala"),
    ],
)
def test_priority_band(spark, days, late, want):
    assert one(spark, bands.priority(F.lit(days), F.lit(late), P)) == want


@pytest.mark.parametrize(
    ("late", "complaint", "keyword", "want"),
    [
        (1, 1, 1, "Terlambat + Komplain Pengiriman"),
        (1, 0, 1, "Terlambat (Alasan Lain)"),
        (0, 0, 1, "Menyebut Keterlambatan"),
        (0, 0, 0, "Alasan Non-Pengiriman"),
    ],
)
def test_one_star_cause(spark, late, complaint, keyword, want):
    assert one(spark, bands.one_star_cause(*map(F.lit, (late, complaint, keyword)))) == want


@pytest.mark.parametrize(
    ("seller", "customer", "want"),
    [
        ("SP", "SP", "SP → SP (Intra SP)"),
        ("SP", "RJ", "SP → Luar SP"),
        ("RJ", "SP", "Luar SP → SP"),
        ("RJ", "MG", "Non-SP → Non-SP"),
        ("unknown", "unknown", "Non-SP → Non-SP"),
        ("unknown", "SP", "Luar SP → SP"),
    ],
)
def test_route_band(spark, seller, customer, want):
    assert one(spark, bands.route(F.lit(seller), F.lit(customer), P)) == want


@pytest.mark.parametrize(
    ("p90", "want"), [(5.0, "Normal"), (5.1, "Perlu Perhatian"), (None, "Normal")]
)
def test_p90_status(spark, p90, want):
    assert one(spark, bands.p90_status(F.lit(p90).cast("double"), P)) == want


def test_score_labels(spark):
    df = spark.range(0, 7).select(bands.score_label(F.col("id")).alias("v"))
    labels = ["Sangat Buruk", "Buruk", "Cukup", "Baik", "Sangat Baik"]
    assert column(df, "v") == [None, *labels, None]


def test_parameters_change_the_rules(spark):
    params = Params(sla_days=(2, 4, 8), hub_state="RJ")
    assert one(spark, bands.sla(F.lit(1.5), params)) == "Fast"
    assert one(spark, bands.route(F.lit("RJ"), F.lit("RJ"), params)) == "RJ → RJ (Intra RJ)"
