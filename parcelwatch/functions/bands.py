"""Classification rules: the first rule that holds names the band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwatch.params import SCORE_LABELS, Params

# Band names as published.
SLA_NAMES = ("Fast", "Normal", "Slow", "Critical")
SLA_RANGES = ("Fast (≤1 hari)", "Normal (1-3 hari)", "Slow (3-7 hari)", "Critical (>7 hari)")
VOLUME_NAMES = ("High Volume", "Medium Volume", "Low Volume")
LOSS_NAMES = ("Besar (>5000)", "Sedang (1000-5000)", "Kecil (<1000)")
PRIORITY_NAMES = ("Intervensi Segera", "Perlu Monitoring", "Pantau Berkala")
CAUSE_NAMES = (
    "Terlambat + Komplain Pengiriman",
    "Terlambat (Alasan Lain)",
    "Menyebut Keterlambatan",
    "Alasan Non-Pengiriman",
)
ROUTE_NAMES = ("SP → SP (Intra SP)", "SP → Luar SP", "Luar SP → SP", "Non-SP → Non-SP")
P90_NAMES = ("Perlu Perhatian", "Normal")


def first_match(tests: Sequence[Column], names: Sequence[str]) -> Column:
    """The name of the first test that holds; the last name where none does."""
    *tested, otherwise = names
    chain = F.when(tests[0], tested[0])
    for test, name in zip(tests[1:], tested[1:], strict=True):
        chain = chain.when(test, name)
    return chain.otherwise(otherwise)


def score_label(score: Column) -> Column:
    chain = None
    for value, label in SCORE_LABELS.items():
        chain = (F if chain is None else chain).when(score == value, label)
    return chain


def one_star_cause(late: Column, complaint: Column, keyword: Column) -> Column:
    return first_match(
        [(late == 1) & (complaint == 1), (late == 1) & (complaint == 0), keyword == 1], CAUSE_NAMES
    )


def p90_status(p90: Column, params: Params) -> Column:
    return first_match([p90 > params.p90_limit_days], P90_NAMES)


def route(seller_state: Column, customer_state: Column, params: Params) -> Column:
    from_hub, to_hub = seller_state == params.hub_state, customer_state == params.hub_state
    names = [name.replace("SP", params.hub_state) for name in ROUTE_NAMES]
    return first_match([from_hub & to_hub, from_hub & ~to_hub, ~from_hub & to_hub], names)


def sla(days: Column, params: Params, names: Sequence[str] = SLA_NAMES) -> Column:
    return first_match([days <= limit for limit in params.sla_days], names)


def volume(orders: Column, params: Params) -> Column:
    return first_match([orders >= bound for bound in params.volume_orders], VOLUME_NAMES)


def freight_loss(amount: Column, params: Params) -> Column:
    return first_match([amount > bound for bound in params.loss_amounts], LOSS_NAMES)


def priority(days: Column, late_pct: Column, params: Params) -> Column:
    rules = (params.act_above, params.monitor_above)
    return first_match([(days > d) & (late_pct > p) for d, p in rules], PRIORITY_NAMES)
