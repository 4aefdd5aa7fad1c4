"""Reports for `spark.sql`: table functions with the business thresholds as named arguments.

    register_functions(spark, wh, "market_")
    spark.sql("SELECT * FROM market_problem_sellers(min_orders => 20) ORDER BY late_rate_pct DESC LIMIT 10")

The functions read the views of a registered warehouse. They are plain SQL that Spark puts into the
query that calls them, so filters and limits of the caller reach the scans. Lists are not cut or
sorted: the caller does both. Thresholds that only label rows are those the functions were
registered with.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from parcelwatch.params import SCORE_LABELS, Params
from parcelwatch.plans.curated import GRAINS, Warehouse


def _half_up(value: str, digits: int) -> str:
    scale = f"{10**digits}.0D"
    return f"(CAST(floor(({value}) * {scale} + 0.5D) AS DOUBLE) / {scale})"


def _pct(part: str, whole: str) -> str:
    return f"try_divide(CAST({part} AS DOUBLE) * 100.0D, CAST({whole} AS DOUBLE))"


def _case(tests: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in tests) + f" ELSE {otherwise} END"


_DAYS = (
    "try_divide(CAST(joined_seller_processing_days_tenths AS DOUBLE),"
    " CAST(joined_seller_processing_days_n AS DOUBLE) * 10.0D)"
)
_SCORE = _half_up("try_divide(CAST(joined_score_sum AS DOUBLE), CAST(joined_scores AS DOUBLE))", 2)


def _score_distribution(p: str, params: Params) -> tuple[str, str, str]:
    label = _case([(f"review_score = {k}", v) for k, v in SCORE_LABELS.items()], "NULL")
    body = f"""
        WITH c AS (
            SELECT review_score, count(*) AS n FROM {p}order_reviews
            WHERE (first_month IS NULL OR order_month >= first_month)
              AND (last_month IS NULL OR order_month <= last_month)
            GROUP BY review_score)
        SELECT review_score, n, {_half_up(_pct('n', '(SELECT sum(n) FROM c)'), 2)}, {label} FROM c"""
    return (
        "first_month STRING DEFAULT NULL, last_month STRING DEFAULT NULL",
        "review_score INT, total_reviews BIGINT, percentage DOUBLE, label STRING",
        body,
    )


def _problem_sellers(p: str, params: Params) -> tuple[str, str, str]:
    fast, normal, slow = params.sla_days
    high, medium = params.volume_orders
    sla = _case([(f"d <= {fast}", "Fast"), (f"d <= {normal}", "Normal"), (f"d <= {slow}", "Slow")], "'Critical'")
    tier = _case([(f"orders >= {high}", "High Volume"), (f"orders >= {medium}", "Medium Volume")], "'Low Volume'")
    mean = "(SELECT try_divide(CAST(sum(CAST(d AS DECIMAL(38, 12))) AS DOUBLE), CAST(count(d) AS DOUBLE)) FROM s)"
    body = f"""
        WITH s AS (
            SELECT *, {_DAYS} AS d FROM {p}{GRAINS}
            WHERE grain = 'seller_place' AND orders >= min_orders)
        SELECT seller_id, seller_state, seller_city, orders, {_half_up('d', 1)}, {_half_up(f'd - {mean}', 1)},
               {_half_up(_pct('late_orders', 'orders'), 1)},
               {_half_up(_pct('joined_late_rows', '(SELECT sum(joined_late_rows) FROM s)'), 2)},
               {_SCORE}, {sla}, {tier} FROM s"""
    return (
        f"min_orders BIGINT DEFAULT {params.min_orders}",
        "seller_id STRING, seller_state STRING, seller_city STRING, total_orders BIGINT, avg_processing_days DOUBLE,"
        " excess_vs_avg DOUBLE, late_rate_pct DOUBLE, contribution_national_late_pct DOUBLE, avg_review_score DOUBLE,"
        " sla_status STRING, seller_tier STRING",
        body,
    )


def _intervention_priority(p: str, params: Params) -> tuple[str, str, str]:
    rate = _pct("joined_late_rows", "joined_rows")
    (act_days, act_pct), (watch_days, watch_pct) = params.act_above, params.monitor_above
    band = _case(
        [
            (f"d > {act_days} AND pct > {act_pct}", "Intervensi Segera"),
            (f"d > {watch_days} AND pct > {watch_pct}", "Perlu Monitoring"),
        ],
        "'Pantau Berkala'",
    )
    body = f"""
        WITH s AS (SELECT *, {_DAYS} AS d, {rate} AS pct FROM {p}{GRAINS} WHERE grain = 'seller_state')
        SELECT seller_id, seller_state, orders, joined_late_rows, {_half_up('pct', 1)}, {_half_up('d', 1)},
               {_half_up(f'd - {params.target_days}', 1)}, {_SCORE}, joined_one_star,
               CAST(joined_late_freight_cents AS DOUBLE) / 100.0D,
               {_half_up(_pct('joined_late_freight_cents', 'joined_freight_cents'), 1)},
               CAST(joined_price_cents AS DOUBLE) / 100.0D, {band}
        FROM s WHERE orders >= min_orders AND d > slow_days AND {_half_up('pct', 1)} > late_pct"""
    return (
        f"min_orders BIGINT DEFAULT {params.min_orders}, slow_days DOUBLE DEFAULT {params.slow_days},"
        f" late_pct DOUBLE DEFAULT {params.late_pct}",
        "seller_id STRING, seller_state STRING, total_orders BIGINT, late_orders BIGINT, late_rate_pct DOUBLE,"
        " avg_processing_days DOUBLE, excess_days_vs_sla DOUBLE, avg_review_score DOUBLE, total_bintang_1 BIGINT,"
        " freight_paid_on_late_orders DOUBLE, pct_freight_on_late_orders DOUBLE, total_revenue DOUBLE,"
        " prioritas_intervensi STRING",
        body,
    )


FUNCTIONS = {
    "score_distribution": _score_distribution,
    "problem_sellers": _problem_sellers,
    "intervention_priority": _intervention_priority,
}


def register_functions(
    spark: SparkSession, wh: Warehouse, prefix: str = "", params: Params | None = None
) -> list[str]:
    """Name the views of a published warehouse, and these reports as functions over them."""
    params = wh.agreed(params)
    if f"{prefix}{GRAINS}" not in wh.register(spark, prefix):
        raise LookupError("reports by name read the measures that refresh(..., facts=True) publishes")
    for name, make in FUNCTIONS.items():
        given, columns, body = make(prefix, params)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS TABLE ({columns}) RETURN {body}"
        )
    return [f"{prefix}{name}" for name in FUNCTIONS]
