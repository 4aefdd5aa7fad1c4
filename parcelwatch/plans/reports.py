"""The fourteen reports. Each takes curated tables and parameters and returns a DataFrame.

Output column names are the published ones. Reports that join orders, items and reviews
weight their measures by the joined rows, as published; `per_order=True` counts each order
and item once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.functions import bands
from parcelwatch.functions.numbers import (
    amount,
    half_up,
    mean_of_tenths,
    percent,
    ratio,
    tenths,
)
from parcelwatch.operators.grains import ROUTE
from parcelwatch.operators.shares import Totals
from parcelwatch.operators.sketches import RANK_ERROR, merged, quantile, rank_check, stage_values
from parcelwatch.params import Params
from parcelwatch.plans.curated import Warehouse

PROCESSING = "seller_processing_days"
CARRIER = "carrier_delivery_days"
TOTAL = "total_delivery_days"


def agreed(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The report with parameters that fit its tables: those of the tables if none are given."""

    @wraps(report)
    def run(wh: Warehouse, params: Params | None = None, **options) -> DataFrame:
        return report(wh, wh.agreed(params), **options)

    return run


# --- measures ---------------------------------------------------------------------------


def mean_days(stage: str) -> Column:
    return mean_of_tenths(F.col(f"{stage}_tenths"), F.col(f"{stage}_n"))


def mean_score() -> Column:
    return half_up(ratio(F.col("score_sum"), F.col("scores")), 2)


def late_order_pct() -> Column:
    return percent(F.col("late_orders"), F.col("orders"))


def late_row_pct() -> Column:
    return percent(F.col("late_rows"), F.col("rows"))


def late_freight_pct() -> Column:
    return percent(F.col("late_freight_cents"), F.col("freight_cents"))


def stage_columns(*stages: str) -> list[str]:
    return [f"{stage}_{part}" for stage in stages for part in ("tenths", "n")]


def sum_and_count(*columns: str) -> list[Column]:
    sums = [F.sum(tenths(c)).alias(f"{c}_tenths") for c in columns]
    return sums + [F.count(c).alias(f"{c}_n") for c in columns]


# --- reviews ----------------------------------------------------------------------------


@agreed
def score_distribution(wh: Warehouse, params: Params | None = None) -> DataFrame:
    counts = (
        wh.table("order_reviews", "review_score")
        .groupBy("review_score")
        .agg(F.count(F.lit(1)).alias("total_reviews"))
    )
    totals = Totals(counts, ("total_reviews",))
    return counts.select(
        "review_score",
        "total_reviews",
        half_up(totals.share("total_reviews"), 2).alias("percentage"),
        bands.score_label(F.col("review_score")).alias("label"),
    ).orderBy("review_score")


@agreed
def delay_vs_score(wh: Warehouse, params: Params | None = None) -> DataFrame:
    reviews = wh.table(
        "order_reviews", "review_score", "order_status", "delay_days", TOTAL, "is_late"
    )
    late = F.sum("is_late")
    return (
        reviews.filter(F.col("order_status") == params.delivered)
        .groupBy("review_score")
        .agg(
            F.count(F.lit(1)).alias("total_reviews"),
            late.alias("total_late_orders"),
            *sum_and_count("delay_days", TOTAL),
        )
        .select(
            "review_score",
            "total_reviews",
            half_up(mean_days("delay_days"), 1).alias("avg_delay_days"),
            half_up(mean_days(TOTAL), 1).alias("avg_delivery_days"),
            "total_late_orders",
            half_up(percent(F.col("total_late_orders"), F.col("total_reviews")), 1).alias(
                "late_pct"
            ),
        )
        .orderBy("review_score")
    )


@agreed
def one_star_causes(wh: Warehouse, params: Params | None = None) -> DataFrame:
    flags = ("is_late", "is_delivery_complaint", "comment_has_delay_keyword")
    return (
        wh.table("order_reviews", "review_score", *flags)
        .filter(F.col("review_score") == 1)
        .groupBy(bands.one_star_cause(*map(F.col, flags)).alias("kategori_masalah"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "kategori_masalah")
    )


# --- orders -----------------------------------------------------------------------------


@agreed
def stage_contribution_monthly(wh: Warehouse, params: Params | None = None) -> DataFrame:
    orders = wh.table("orders", "order_status", "order_month", PROCESSING, CARRIER, TOTAL)
    return (
        orders.filter(_delivered_in_known_month(params))
        .groupBy("order_month")
        .agg(F.count(F.lit(1)).alias("total_orders"), *sum_and_count(PROCESSING, CARRIER, TOTAL))
        .select(
            "order_month",
            "total_orders",
            half_up(mean_days(PROCESSING), 1).alias("avg_seller_processing_days"),
            half_up(mean_days(CARRIER), 1).alias("avg_carrier_days"),
            half_up(percent(mean_days(PROCESSING), mean_days(TOTAL)), 1).alias(
                "seller_contribution_pct"
            ),
        )
        .orderBy("order_month")
    )


@agreed
def late_rate_monthly(wh: Warehouse, params: Params | None = None) -> DataFrame:
    orders = wh.table("orders", "order_id", "order_status", "order_month", "is_late")
    once = (
        orders.filter(_delivered_in_known_month(params))
        .groupBy("order_month", "order_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("is_late").alias("late_rows"),
            F.max("is_late").alias("late"),
        )
    )
    return (
        once.groupBy("order_month")
        .agg(
            F.sum("rows").alias("total_orders"),
            F.sum("late_rows").alias("late_orders"),
            half_up(percent(F.sum("late"), F.count("order_id")), 1).alias("late_rate_pct"),
        )
        .orderBy("order_month")
    )


def _delivered_in_known_month(params: Params) -> Column:
    return (F.col("order_status") == params.delivered) & (F.col("order_month") != "unknown")


# Names of the two compared stages.
COMPONENTS = {PROCESSING: "Seller Processing Time", CARRIER: "Carrier Transit Time"}


@agreed
def stage_statistics(wh: Warehouse, params: Params | None = None) -> DataFrame:
    """Both stages from one scan.

    Exact quantiles come from a histogram: durations are whole tenths of a day, so the number
    of distinct values is bounded by the longest delivery and not by the number of orders.
    """
    histogram = (
        _positive_stages(wh, params)
        .groupBy("component", "tenths")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _component_rows(
        histogram,
        lambda value, q: F.percentile(value, q, F.coalesce("n", F.lit(0))),
        F.col("n"),
        params,
    )


@agreed
def approximate_stage_statistics(
    wh: Warehouse, params: Params | None = None, accuracy: int = 10000
) -> DataFrame:
    """As `stage_statistics`, with quantile sketches: they return an observed value."""
    return _component_rows(
        _positive_stages(wh, params),
        lambda value, q: F.percentile_approx(value, q, accuracy),
        F.lit(1),
        params,
    )


@agreed
def merged_stage_quantiles(
    wh: Warehouse, params: Params | None = None, months: tuple[str, str] | None = None
) -> DataFrame:
    """The quantiles of both stages over a range of months (all by default), out of sketches.

    Nothing but the sketches of those months is read where they are published.
    """
    sketches = wh.sketches()
    if months:
        sketches = sketches.filter(F.col("order_month").between(*months))
    p50, p90 = (half_up(quantile(F.col("sketch"), q) / 10.0, 1) for q in params.quantiles)
    label = F.create_map(*[F.lit(v) for pair in COMPONENTS.items() for v in pair])
    return merged(sketches, ("component",)).select(
        label[F.col("component")].alias("komponen"), "n", p50.alias("median_hari"), p90.alias("p90_hari")
    )


@agreed
def check_merged_quantiles(wh: Warehouse, params: Params | None = None, error: float = RANK_ERROR) -> DataFrame:
    """Whether the merged quantiles lie within `error` of their rank among all values."""
    whole = merged(wh.sketches(), ("component",))
    pairs = [F.struct(F.lit(q).alias("q"), quantile(F.col("sketch"), q).alias("estimate")) for q in params.quantiles]
    found = whole.select("component", F.explode(F.array(*pairs)).alias("e")).select("component", "e.*")
    return rank_check(_positive_stages(wh, params), ("component",), "tenths", found, error)


@agreed
def check_approximate_quantiles(
    wh: Warehouse, params: Params | None = None, accuracy: int = 10000
) -> DataFrame:
    """Whether the approximate quantiles lie within 1 / accuracy of their rank among all values."""
    values = _positive_stages(wh, params)
    at = F.percentile_approx("tenths", list(params.quantiles), accuracy)
    found = values.groupBy("component").agg(at.alias("estimates"))
    pairs = F.arrays_zip(F.array(*map(F.lit, params.quantiles)).alias("q"), F.col("estimates").alias("estimate"))
    found = found.select("component", F.explode(pairs).alias("e")).select(
        "component", F.col("e.q").alias("q"), F.col("e.estimate").alias("estimate")
    )
    return rank_check(values, ("component",), "tenths", found, 1 / accuracy)


def _positive_stages(wh: Warehouse, params: Params) -> DataFrame:
    orders = wh.table("orders", "order_status", *COMPONENTS)
    return stage_values(orders, params.delivered)


def _component_rows(
    values: DataFrame,
    quantile: Callable[[Column, float], Column],
    weight: Column,
    params: Params,
) -> DataFrame:
    def statistics(stage: str) -> Column:
        mine = F.col("component") == stage
        value = F.when(mine, F.col("tenths"))
        p50, p90 = (quantile(value, q) for q in params.quantiles)
        return F.struct(
            F.lit(COMPONENTS[stage]).alias("component"),
            F.sum(value * weight).alias("total"),
            F.sum(F.when(mine, weight)).alias("n"),
            p50.alias("p50"),
            p90.alias("p90"),
            F.max(value).alias("longest"),
        )

    # A global aggregate always has its row, so both components appear even without data.
    rows = values.agg(*[statistics(stage).alias(stage) for stage in COMPONENTS])
    p90 = half_up(F.col("s.p90") / 10.0, 1)
    return rows.select(F.explode(F.array(*COMPONENTS)).alias("s")).select(
        F.col("s.component").alias("komponen"),
        half_up(mean_of_tenths(F.col("s.total"), F.col("s.n")), 1).alias("rata_rata_hari"),
        half_up(F.col("s.p50") / 10.0, 1).alias("median_hari"),
        p90.alias("p90_hari"),
        half_up(F.col("s.longest") / 10.0, 0).alias("maksimum_hari"),
        bands.p90_status(p90, params).alias("status_p90"),
    )


# --- places -----------------------------------------------------------------------------


@agreed
def late_rate_by_state(wh: Warehouse, params: Params | None = None) -> DataFrame:
    measures = ["orders", "late_orders", "rows", "late_rows", *stage_columns(TOTAL)]
    states = wh.measures("state", measures, params, "items")
    totals = _totals(states, TOTAL)
    return states.select(
        "customer_state",
        F.col("orders").alias("total_orders"),
        half_up(late_row_pct(), 1).alias("late_rate_pct_WRONG"),
        half_up(late_order_pct(), 1).alias("late_rate_pct"),
        half_up(totals.share("late_orders"), 2).alias("contribution_to_national_late_pct"),
        half_up(_gap(totals, TOTAL, params), 1).alias("diff_vs_national_avg_days"),
    ).orderBy(F.desc("contribution_to_national_late_pct"), "customer_state")


def _totals(grouped: DataFrame, stage: str) -> Totals:
    measures = tuple(c for c, kind in grouped.dtypes if kind == "bigint")
    return Totals(grouped, measures, {stage: mean_days(stage)})


def _gap(totals: Totals, stage: str, params: Params) -> Column:
    """Distance of a group's average to the mean of all groups, or to the average row."""
    if params.weighted_gap:
        overall = mean_of_tenths(totals.total(f"{stage}_tenths"), totals.total(f"{stage}_n"))
    else:
        overall = totals.mean(stage)
    return mean_days(stage) - overall


@agreed
def stages_by_state(
    wh: Warehouse, params: Params | None = None, per_order: bool = False
) -> DataFrame:
    measures = ["orders", "rows", "late_rows", "score_sum", "scores"]
    measures += stage_columns(PROCESSING, CARRIER, TOTAL)
    return (
        wh.measures("state", measures, params, _counting(per_order))
        .select(
            "customer_state",
            F.col("orders").alias("total_orders"),
            half_up(mean_days(PROCESSING), 1).alias("avg_seller_processing"),
            half_up(mean_days(CARRIER), 1).alias("avg_carrier_days"),
            half_up(mean_days(TOTAL), 1).alias("avg_total_days"),
            half_up(late_row_pct(), 1).alias("late_rate_pct"),
            mean_score().alias("avg_review_score"),
        )
        .orderBy(F.desc("late_rate_pct"), "customer_state")
    )


@agreed
def route_comparison(wh: Warehouse, params: Params | None = None) -> DataFrame:
    measures = ["orders", "late_orders", "score_sum", "scores"]
    measures += stage_columns(PROCESSING, CARRIER)
    return (
        wh.measures("route", measures, params, "joined")
        .select(
            ROUTE,
            F.col("orders").alias("total_orders"),
            half_up(mean_days(PROCESSING), 1).alias("avg_seller_processing"),
            half_up(mean_days(CARRIER), 1).alias("avg_carrier_days"),
            half_up(late_order_pct(), 1).alias("late_rate_pct"),
            mean_score().alias("avg_review_score"),
        )
        .orderBy(F.desc("late_rate_pct"), ROUTE)
    )


# --- sellers ----------------------------------------------------------------------------


@agreed
def problem_sellers(wh: Warehouse, params: Params | None = None) -> DataFrame:
    keys = ["seller_id", "seller_state", "seller_city"]
    measures = ["orders", "late_orders", "late_rows", "score_sum", "scores"]
    measures += stage_columns(PROCESSING)
    sellers = wh.measures("seller_place", measures, params, "joined")
    sellers = sellers.filter(F.col("orders") >= params.min_orders)
    totals = _totals(sellers, PROCESSING)
    return (
        sellers.select(
            *keys,
            F.col("orders").alias("total_orders"),
            half_up(mean_days(PROCESSING), 1).alias("avg_processing_days"),
            half_up(_gap(totals, PROCESSING, params), 1).alias("excess_vs_avg"),
            half_up(late_order_pct(), 1).alias("late_rate_pct"),
            half_up(totals.share("late_rows"), 2).alias("contribution_national_late_pct"),
            mean_score().alias("avg_review_score"),
            bands.sla(mean_days(PROCESSING), params).alias("sla_status"),
            bands.volume(F.col("orders"), params).alias("seller_tier"),
        )
        .orderBy(F.desc("contribution_national_late_pct"), *keys)
        .limit(params.top_contributors)
    )


def _seller_losses(wh: Warehouse, params: Params, per_order: bool) -> DataFrame:
    """Measures of each seller's delivered orders, for the two loss lists."""
    measures = ["orders", "late_orders", "rows", "late_rows", *stage_columns(PROCESSING)]
    measures += ["price_cents", "freight_cents", "late_freight_cents"]
    measures += ["score_sum", "scores", "one_star"]
    sellers = wh.measures("seller_state", measures, params, _counting(per_order))
    return sellers.filter(
        (F.col("orders") >= params.min_orders) & (mean_days(PROCESSING) > params.slow_days)
    )


def _counting(per_order: bool) -> str:
    return "once" if per_order else "joined"


@agreed
def freight_loss(wh: Warehouse, params: Params | None = None, per_order: bool = False) -> DataFrame:
    return (
        _seller_losses(wh, params, per_order)
        .filter(late_order_pct() > params.late_pct)
        .select(
            "seller_id",
            "seller_state",
            F.col("orders").alias("total_orders"),
            half_up(mean_days(PROCESSING), 1).alias("avg_processing_days"),
            half_up(late_order_pct(), 1).alias("late_rate_pct"),
            amount(F.col("price_cents")).alias("total_revenue"),
            amount(F.col("freight_cents")).alias("total_freight_charged"),
            amount(F.col("late_freight_cents")).alias("freight_on_late_orders"),
            half_up(late_freight_pct(), 1).alias("pct_freight_wasted"),
            mean_score().alias("avg_review_score"),
            F.col("one_star").alias("total_1star"),
        )
        .orderBy(F.desc("freight_on_late_orders"), "seller_id", "seller_state")
        .limit(params.top_losses)
    )


@agreed
def freight_loss_bands(wh: Warehouse, params: Params | None = None) -> DataFrame:
    measures = ["orders", "late_freight_cents", *stage_columns(PROCESSING)]
    sellers = wh.measures("seller", measures, params, "items").filter(
        (mean_days(PROCESSING) > params.slow_days) & (F.col("orders") >= params.min_orders)
    )
    band = bands.freight_loss(amount(F.col("late_freight_cents")), params)
    return (
        sellers.groupBy(band.alias("kategori_kerugian"))
        .agg(
            F.count(F.lit(1)).alias("jumlah_seller"),
            amount(F.sum("late_freight_cents")).alias("total_freight_wasted"),
        )
        .orderBy(F.desc("total_freight_wasted"), "kategori_kerugian")
    )


@agreed
def sla_distribution(
    wh: Warehouse, params: Params | None = None, per_order: bool = False
) -> DataFrame:
    """Seller rates are rounded before they are averaged over the band, as published."""
    measures = ["orders", "rows", "late_rows", "score_sum", "scores", *stage_columns(PROCESSING)]
    sellers = wh.measures("seller_processed", measures, params, _counting(per_order))
    sellers = sellers.filter(F.col("orders") >= params.min_orders_sla)
    category = bands.sla(mean_days(PROCESSING), params, bands.SLA_RANGES)
    rate = tenths(half_up(late_row_pct(), 1))
    score = F.round(mean_score() * 100.0).cast("bigint")
    bands_ = sellers.groupBy(category.alias("sla_category")).agg(
        F.count("seller_id").alias("jumlah_seller"),
        F.sum("orders").alias("total_orders_in_category"),
        F.sum(rate).alias("rate_tenths"),
        F.count(rate).alias("rates"),
        F.sum(score).alias("score_hundredths"),
        F.count(score).alias("scores"),
    )
    totals = Totals(bands_, tuple(c for c in bands_.columns if c != "sla_category"))
    rank = bands.first_match(
        [F.col("sla_category") == name for name in bands.SLA_RANGES[:-1]], (1, 2, 3, 4)
    )
    mean = ratio(F.col("score_hundredths"), F.col("scores") * 100)
    return bands_.select(
        "sla_category",
        "jumlah_seller",
        "total_orders_in_category",
        half_up(totals.share("total_orders_in_category"), 1).alias("order_share_pct"),
        half_up(mean_of_tenths(F.col("rate_tenths"), F.col("rates")), 1).alias("avg_late_rate"),
        half_up(mean, 2).alias("avg_review_score"),
    ).orderBy(rank)


@agreed
def intervention_priority(
    wh: Warehouse, params: Params | None = None, per_order: bool = False
) -> DataFrame:
    days, late_pct = mean_days(PROCESSING), late_row_pct()
    return (
        _seller_losses(wh, params, per_order)
        .filter(half_up(late_pct, 1) > params.late_pct)
        .select(
            "seller_id",
            "seller_state",
            F.col("orders").alias("total_orders"),
            F.col("late_rows").alias("late_orders"),
            half_up(late_pct, 1).alias("late_rate_pct"),
            half_up(days, 1).alias("avg_processing_days"),
            half_up(days - params.target_days, 1).alias("excess_days_vs_sla"),
            mean_score().alias("avg_review_score"),
            F.col("one_star").alias("total_bintang_1"),
            amount(F.col("late_freight_cents")).alias("freight_paid_on_late_orders"),
            half_up(late_freight_pct(), 1).alias("pct_freight_on_late_orders"),
            amount(F.col("price_cents")).alias("total_revenue"),
            bands.priority(days, late_pct, params).alias("prioritas_intervensi"),
        )
        .orderBy(F.desc("freight_paid_on_late_orders"), "seller_id", "seller_state")
        .limit(params.top_losses)
    )


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "score_distribution": score_distribution,
    "delay_vs_score": delay_vs_score,
    "one_star_causes": one_star_causes,
    "stage_contribution_monthly": stage_contribution_monthly,
    "late_rate_monthly": late_rate_monthly,
    "stage_statistics": stage_statistics,
    "late_rate_by_state": late_rate_by_state,
    "stages_by_state": stages_by_state,
    "route_comparison": route_comparison,
    "problem_sellers": problem_sellers,
    "freight_loss": freight_loss,
    "freight_loss_bands": freight_loss_bands,
    "sla_distribution": sla_distribution,
    "intervention_priority": intervention_priority,
}

# Reports with a variant that counts each order and item once.
PER_ORDER = ("stages_by_state", "freight_loss", "sla_distribution", "intervention_priority")
