"""Oracle texts of the fourteen reports and their per-order variants."""

from __future__ import annotations

from checks.oracle import (
    LATE_FREIGHT,
    LATE_SEEN,
    ONE_STAR,
    ORDERS_SEEN,
    ROW_LATE,
    SCORE,
    SLA_NAMES,
    SLA_RANGES,
    big,
    days,
    half_up,
    money,
    pct,
    sla,
)

DELIVERED = "order_status = 'delivered'"

SCORE_DISTRIBUTION = f"""
WITH counted AS (SELECT review_score, count(*) AS c FROM c_reviews GROUP BY ALL)
SELECT review_score, c AS total_reviews,
       {half_up(pct('c', '(SELECT sum(c) FROM counted)'), 2)} AS percentage,
       CASE review_score WHEN 1 THEN 'Sangat Buruk' WHEN 2 THEN 'Buruk' WHEN 3 THEN 'Cukup'
                         WHEN 4 THEN 'Baik' WHEN 5 THEN 'Sangat Baik' END AS label
FROM counted"""

DELAY_VS_SCORE = f"""
SELECT review_score, count(*) AS total_reviews,
       {half_up(days('CAST(round(delay_days * 10) AS BIGINT)'), 1)} AS avg_delay_days,
       {half_up(days('CAST(round(total_delivery_days * 10) AS BIGINT)'), 1)}
           AS avg_delivery_days,
       {big('sum(is_late)')} AS total_late_orders,
       {half_up(ROW_LATE, 1)} AS late_pct
FROM c_reviews WHERE {DELIVERED} GROUP BY review_score"""

CAUSE = """
CASE WHEN is_late = 1 AND is_delivery_complaint = 1 THEN 'Terlambat + Komplain Pengiriman'
     WHEN is_late = 1 AND is_delivery_complaint = 0 THEN 'Terlambat (Alasan Lain)'
     WHEN comment_has_delay_keyword = 1 THEN 'Menyebut Keterlambatan'
     ELSE 'Alasan Non-Pengiriman' END"""

ONE_STAR_CAUSES = f"""
SELECT {CAUSE} AS kategori_masalah, count(*) AS total
FROM c_reviews WHERE review_score = 1 GROUP BY 1"""

STAGE_CONTRIBUTION = f"""
SELECT order_month, count(*) AS total_orders,
       {half_up(days('proc'), 1)} AS avg_seller_processing_days,
       {half_up(days('carr'), 1)} AS avg_carrier_days,
       {half_up(pct(days('proc'), days('tot')), 1)} AS seller_contribution_pct
FROM ord WHERE {DELIVERED} AND order_month <> 'unknown' GROUP BY order_month"""

LATE_MONTHLY = f"""
SELECT order_month, count(*) AS total_orders, {big('sum(is_late)')} AS late_orders,
       {half_up(pct(LATE_SEEN, ORDERS_SEEN), 1)} AS late_rate_pct
FROM ord WHERE {DELIVERED} AND order_month <> 'unknown' GROUP BY order_month"""


def _component(label: str, column: str) -> str:
    p90 = half_up(f"quantile_cont({column}, 0.9) / 10.0::DOUBLE", 1)
    return f"""
SELECT '{label}' AS komponen, {half_up(days(column), 1)} AS rata_rata_hari,
       {half_up(f"quantile_cont({column}, 0.5) / 10.0::DOUBLE", 1)} AS median_hari,
       {p90} AS p90_hari, {half_up(f"max({column}) / 10.0::DOUBLE", 0)} AS maksimum_hari,
       CASE WHEN {p90} > 5 THEN 'Perlu Perhatian' ELSE 'Normal' END AS status_p90
FROM ord WHERE {DELIVERED} AND {column} > 0"""


STAGE_STATISTICS = (
    _component("Seller Processing Time", "proc")
    + "\nUNION ALL"
    + _component("Carrier Transit Time", "carr")
)

LATE_BY_STATE = f"""
WITH per_state AS (
    SELECT customer_state, {ORDERS_SEEN} AS n, {LATE_SEEN} AS late_n,
           {ROW_LATE} AS row_pct, {days('tot')} AS avg_tot
    FROM oi WHERE {DELIVERED} GROUP BY customer_state)
SELECT customer_state, n AS total_orders, {half_up('row_pct', 1)} AS "late_rate_pct_WRONG",
       {half_up(pct('late_n', 'n'), 1)} AS late_rate_pct,
       {half_up(pct('late_n', 'sum(late_n) OVER ()'), 2)} AS contribution_to_national_late_pct,
       {half_up('avg_tot - avg(avg_tot) OVER ()', 1)} AS diff_vs_national_avg_days
FROM per_state"""

STAGES_BY_STATE = f"""
SELECT customer_state, {ORDERS_SEEN} AS total_orders,
       {half_up(days('proc'), 1)} AS avg_seller_processing,
       {half_up(days('carr'), 1)} AS avg_carrier_days,
       {half_up(days('tot'), 1)} AS avg_total_days,
       {half_up(ROW_LATE, 1)} AS late_rate_pct, {SCORE} AS avg_review_score
FROM oir WHERE {DELIVERED} GROUP BY customer_state"""

ROUTE = """
CASE WHEN seller_state = 'SP' THEN
          CASE WHEN customer_state = 'SP' THEN 'SP → SP (Intra SP)' ELSE 'SP → Luar SP' END
     WHEN customer_state = 'SP' THEN 'Luar SP → SP'
     ELSE 'Non-SP → Non-SP' END"""

ROUTES = f"""
SELECT {ROUTE} AS rute_pengiriman, {ORDERS_SEEN} AS total_orders,
       {half_up(days('proc'), 1)} AS avg_seller_processing,
       {half_up(days('carr'), 1)} AS avg_carrier_days,
       {half_up(pct(LATE_SEEN, ORDERS_SEEN), 1)} AS late_rate_pct, {SCORE} AS avg_review_score
FROM oir WHERE {DELIVERED} GROUP BY 1"""

PROBLEM_SELLERS = f"""
WITH per_seller AS (
    SELECT seller_id, seller_state, seller_city, {ORDERS_SEEN} AS n, {LATE_SEEN} AS late_n,
           sum(is_late) AS late_rows, {days('proc')} AS d, {SCORE} AS sc
    FROM oir WHERE order_status IN ('delivered', 'shipped') AND proc >= 0
    GROUP BY seller_id, seller_state, seller_city HAVING {ORDERS_SEEN} >= 50)
SELECT seller_id, seller_state, seller_city, n AS total_orders,
       {half_up('d', 1)} AS avg_processing_days,
       {half_up('d - avg(d) OVER ()', 1)} AS excess_vs_avg,
       {half_up(pct('late_n', 'n'), 1)} AS late_rate_pct,
       {half_up(pct('late_rows', 'sum(late_rows) OVER ()'), 2)}
           AS contribution_national_late_pct,
       sc AS avg_review_score, {sla('d', SLA_NAMES)} AS sla_status,
       CASE WHEN n >= 500 THEN 'High Volume' WHEN n >= 100 THEN 'Medium Volume'
            ELSE 'Low Volume' END AS seller_tier
FROM per_seller
ORDER BY contribution_national_late_pct DESC NULLS LAST, seller_id, seller_state, seller_city
LIMIT 50"""

# Rows as published, or one row per seller and order with the item sums of that pair.
PER_ORDER_SELLER = """
    SELECT order_id, seller_id, seller_state, order_status, is_late, proc,
           price_c, freight_c, score_sum, scores, stars
    FROM (SELECT order_id, seller_id, seller_state, sum(price_c) AS price_c,
                 sum(freight_c) AS freight_c
          FROM itm GROUP BY ALL)
    JOIN ord USING (order_id)
    LEFT JOIN (SELECT order_id, sum(review_score) AS score_sum, count(review_score) AS scores,
                      count(*) FILTER (WHERE review_score = 1) AS stars
               FROM c_reviews GROUP BY order_id) USING (order_id)"""
ONCE_SCORE = half_up("sum(score_sum)::DOUBLE / nullif(sum(scores), 0)::DOUBLE", 2)
ONCE_STARS = "coalesce(sum(stars), 0)"


def freight_loss(per_order: bool = False) -> str:
    source = f"({PER_ORDER_SELLER})" if per_order else "oir"
    return f"""
SELECT seller_id, seller_state, {ORDERS_SEEN} AS total_orders,
       {half_up(days('proc'), 1)} AS avg_processing_days,
       {half_up(pct(LATE_SEEN, ORDERS_SEEN), 1)} AS late_rate_pct,
       {money('sum(price_c)')} AS total_revenue,
       {money('sum(freight_c)')} AS total_freight_charged,
       {money(LATE_FREIGHT)} AS freight_on_late_orders,
       {half_up(pct(LATE_FREIGHT, 'sum(freight_c)'), 1)} AS pct_freight_wasted,
       {ONCE_SCORE if per_order else SCORE} AS avg_review_score,
       {big(ONCE_STARS if per_order else ONE_STAR)} AS total_1star
FROM {source} WHERE {DELIVERED} GROUP BY seller_id, seller_state
HAVING {ORDERS_SEEN} >= 50 AND {days('proc')} > 2 AND {pct(LATE_SEEN, ORDERS_SEEN)} > 20
ORDER BY freight_on_late_orders DESC NULLS LAST, seller_id, seller_state LIMIT 20"""


def intervention(per_order: bool = False) -> str:
    source = f"({PER_ORDER_SELLER})" if per_order else "oir"
    return f"""
SELECT seller_id, seller_state, {ORDERS_SEEN} AS total_orders,
       {big('sum(is_late)')} AS late_orders, {half_up(ROW_LATE, 1)} AS late_rate_pct,
       {half_up(days('proc'), 1)} AS avg_processing_days,
       {half_up(days('proc') + ' - 2', 1)} AS excess_days_vs_sla,
       {ONCE_SCORE if per_order else SCORE} AS avg_review_score,
       {big(ONCE_STARS if per_order else ONE_STAR)} AS total_bintang_1,
       {money(LATE_FREIGHT)} AS freight_paid_on_late_orders,
       {half_up(pct(LATE_FREIGHT, 'sum(freight_c)'), 1)} AS pct_freight_on_late_orders,
       {money('sum(price_c)')} AS total_revenue,
       CASE WHEN {days('proc')} > 7 AND {ROW_LATE} > 30 THEN 'Intervensi Segera'
            WHEN {days('proc')} > 3 AND {ROW_LATE} > 20 THEN 'Perlu Monitoring'
            ELSE 'Pantau Berkala' END AS prioritas_intervensi
FROM {source} WHERE {DELIVERED} GROUP BY seller_id, seller_state
HAVING {ORDERS_SEEN} >= 50 AND {half_up(ROW_LATE, 1)} > 20 AND {days('proc')} > 2
ORDER BY freight_paid_on_late_orders DESC NULLS LAST, seller_id, seller_state LIMIT 20"""


LOSS_BANDS = f"""
SELECT kategori_kerugian, count(*) AS jumlah_seller,
       {money('sum(wasted)')} AS total_freight_wasted
FROM (SELECT wasted, CASE WHEN wasted > 500000 THEN 'Besar (>5000)'
                          WHEN wasted > 100000 THEN 'Sedang (1000-5000)'
                          ELSE 'Kecil (<1000)' END AS kategori_kerugian
      FROM (SELECT {LATE_FREIGHT} AS wasted FROM oi WHERE {DELIVERED}
            GROUP BY seller_id HAVING {days('proc')} > 2 AND {ORDERS_SEEN} >= 50))
GROUP BY kategori_kerugian"""


def sla_distribution(per_order: bool = False) -> str:
    source = "oir"
    score = SCORE
    if per_order:
        source, score = f"({PER_ORDER_SELLER})", ONCE_SCORE
    share = pct("sum(n)", "sum(sum(n)) OVER ()")
    rate = "sum(floor(late_pct * 10 + 0.5))::DOUBLE / (nullif(count(late_pct), 0) * 10.0::DOUBLE)"
    mean = "sum(floor(sc * 100 + 0.5))::DOUBLE / (nullif(count(sc), 0) * 100)::DOUBLE"
    return f"""
SELECT {sla('d', SLA_RANGES)} AS sla_category, count(seller_id) AS jumlah_seller,
       {big('sum(n)')} AS total_orders_in_category, {half_up(share, 1)} AS order_share_pct,
       {half_up(rate, 1)} AS avg_late_rate, {half_up(mean, 2)} AS avg_review_score
FROM (SELECT seller_id, {ORDERS_SEEN} AS n, {days('proc')} AS d,
             {half_up(ROW_LATE, 1)} AS late_pct, {score} AS sc
      FROM {source} WHERE {DELIVERED} AND proc >= 0
      GROUP BY seller_id HAVING {ORDERS_SEEN} >= 10)
GROUP BY sla_category"""


STAGES_BY_STATE_PER_ORDER = f"""
SELECT customer_state, {ORDERS_SEEN} AS total_orders,
       {half_up(days('proc'), 1)} AS avg_seller_processing,
       {half_up(days('carr'), 1)} AS avg_carrier_days,
       {half_up(days('tot'), 1)} AS avg_total_days,
       {half_up(ROW_LATE, 1)} AS late_rate_pct, {ONCE_SCORE} AS avg_review_score
FROM (SELECT DISTINCT order_id, customer_state FROM itm)
JOIN ord USING (order_id)
LEFT JOIN (SELECT order_id, sum(review_score) AS score_sum, count(review_score) AS scores
           FROM c_reviews GROUP BY order_id) USING (order_id)
WHERE {DELIVERED} GROUP BY customer_state"""

REPORT_SQL = {
    "score_distribution": SCORE_DISTRIBUTION,
    "delay_vs_score": DELAY_VS_SCORE,
    "one_star_causes": ONE_STAR_CAUSES,
    "stage_contribution_monthly": STAGE_CONTRIBUTION,
    "late_rate_monthly": LATE_MONTHLY,
    "stage_statistics": STAGE_STATISTICS,
    "late_rate_by_state": LATE_BY_STATE,
    "stages_by_state": STAGES_BY_STATE,
    "route_comparison": ROUTES,
    "problem_sellers": PROBLEM_SELLERS,
    "freight_loss": freight_loss(),
    "freight_loss_bands": LOSS_BANDS,
    "sla_distribution": sla_distribution(),
    "intervention_priority": intervention(),
    "stages_by_state_per_order": STAGES_BY_STATE_PER_ORDER,
    "freight_loss_per_order": freight_loss(True),
    "sla_distribution_per_order": sla_distribution(True),
    "intervention_priority_per_order": intervention(True),
}
