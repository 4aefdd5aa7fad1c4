"""SQL oracles, written independently of the Spark code and run by DuckDB.

Every text starts from the shared test tables and derives the raw tables (FIXTURES.md), the
enriched and null-filled tables and the literal orders x items x reviews join. Reports are
then plain GROUP BYs over that join: the weighted form of the library is never used here.
"""

from __future__ import annotations

# --- derivation of the raw tables -----------------------------------------------------------

RAW = {
    "cfg": "SELECT count(*) AS ns FROM supplier",
    "nations": """
        SELECT n_nationkey AS nk, CASE WHEN n_nationkey % 3 = 0 THEN 'SP' ELSE n_name END AS st
        FROM nation""",
    "raw_customers": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
               'person-' || c_custkey AS customer_unique_id,
               CAST(c_custkey % 40 AS INTEGER) AS customer_zip_code_prefix,
               c_mktsegment AS customer_city, st AS customer_state
        FROM customer LEFT JOIN nations ON nk = c_nationkey""",
    "raw_sellers": """
        SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
               CAST(s_suppkey % 40 AS INTEGER) AS seller_zip_code_prefix,
               s_name AS seller_city, st AS seller_state
        FROM supplier LEFT JOIN nations ON nk = s_nationkey""",
    "raw_geo": """
        SELECT CAST(c_custkey % 40 AS INTEGER) AS geolocation_zip_code_prefix,
               (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90.0 AS geolocation_lat,
               (c_custkey * 53 % 3600) / 10.0::DOUBLE - 180.0 AS geolocation_lng,
               CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS geolocation_city,
               st AS geolocation_state
        FROM customer LEFT JOIN nations ON nk = c_nationkey""",
    "main_seller": """
        SELECT o_orderkey AS ok, ((o_orderkey % ns) * ((o_orderkey // ns) % ns)) // ns AS sk
        FROM orders, cfg""",
    "clocked": """
        SELECT x.*,
               CASE WHEN status = 'delivered' AND ok % 97 <> 0
                    THEN carrier + to_seconds(transit) END AS delivered
        FROM (
            SELECT ok, o_custkey, status, o_orderdate AS purchase,
                   CASE WHEN ok % 101 <> 0
                        THEN o_orderdate + to_seconds(3600 * (1 + ok % 30)) END AS approved,
                   CASE WHEN status IN ('processing', 'canceled') THEN NULL
                        WHEN ok % 103 = 0 THEN o_orderdate
                        ELSE o_orderdate + to_seconds(3600 * (1 + ok % 30)
                             + (sk * 3 % 11) * 86400 + (ok * 7919) % 86400) END AS carrier,
                   (2 + ok % 9) * 86400 + (ok * 104729) % 86400
                       + CASE WHEN cn.st <> sn.st THEN 4 * 86400 ELSE 0 END AS transit,
                   o_orderdate + to_seconds((14 + ok % 8) * 86400) AS estimated
            FROM (SELECT *, CASE WHEN o_orderkey % 20 <= 16 THEN 'delivered'
                                 WHEN o_orderkey % 20 = 17 THEN 'shipped'
                                 WHEN o_orderkey % 20 = 18 THEN 'processing'
                                 ELSE 'canceled' END AS status FROM orders) o
            JOIN main_seller ON ok = o_orderkey
            LEFT JOIN customer ON c_custkey = o_custkey
            LEFT JOIN nations cn ON cn.nk = c_nationkey
            LEFT JOIN supplier ON s_suppkey = sk
            LEFT JOIN nations sn ON sn.nk = s_nationkey) x""",
    "raw_orders": """
        SELECT CAST(ok AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               status AS order_status,
               strftime(purchase, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
               strftime(approved, '%Y-%m-%d %H:%M:%S') AS order_approved_at,
               strftime(carrier, '%Y-%m-%d %H:%M:%S') AS order_delivered_carrier_date,
               strftime(delivered, '%Y-%m-%d %H:%M:%S') AS order_delivered_customer_date,
               strftime(estimated, '%Y-%m-%d %H:%M:%S') AS order_estimated_delivery_date
        FROM clocked""",
    "raw_items": """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
               CAST(l_linenumber AS INTEGER) AS order_item_id,
               CAST(l_partkey AS VARCHAR) AS product_id,
               CAST(CASE WHEN l_linenumber >= 6 THEN (sk + 1) % ns ELSE sk END AS VARCHAR)
                   AS seller_id,
               strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipping_limit_date,
               floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS price,
               floor(l_quantity * l_tax * 10.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE)
                   / 100.0::DOUBLE AS freight_value
        FROM (SELECT *, ((l_orderkey % ns) * ((l_orderkey // ns) % ns)) // ns AS sk
              FROM lineitem, cfg)""",
    "raw_reviews": """
        SELECT CAST(ok * 2 + copy AS VARCHAR) AS review_id, CAST(ok AS VARCHAR) AS order_id,
               CAST(CASE WHEN status = 'delivered' AND delivered > estimated AND ok % 7 <> 0
                         THEN 1 + ok % 3
                         WHEN ok % 17 = 0 THEN 1
                         ELSE 3 + ok % 3 END AS INTEGER) AS review_score,
               CASE WHEN ok % 4 <> 0 THEN 'Avaliacao' END AS review_comment_title,
               CASE ok % 9 WHEN 0 THEN 'Produto chegou com ATRASO' WHEN 1 THEN 'demorou muito'
                           WHEN 2 THEN 'Boa tarde, tudo certo' WHEN 3 THEN 'Great chocolate'
                           WHEN 4 THEN 'Never arrived!' WHEN 5 THEN NULL ELSE 'ok' END
                   AS review_comment_message,
               strftime(estimated, '%Y-%m-%d %H:%M:%S') AS review_creation_date,
               strftime(estimated + to_days(2), '%Y-%m-%d %H:%M:%S') AS review_answer_timestamp
        FROM clocked, (SELECT 0 AS copy UNION ALL SELECT 1) c
        WHERE ok % 10 < 8 AND (copy = 0 OR ok % 50 = 0)""",
    "raw_payments": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, part AS payment_sequential,
               CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto'
                                   WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
               CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments,
               floor(o_totalprice * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE
                   AS payment_value
        FROM orders, (SELECT 1 AS part UNION ALL SELECT 2) c
        WHERE part = 1 OR o_orderkey % 9 = 0""",
    "raw_products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id,
               CASE WHEN p_partkey % 13 <> 0 THEN lower(p_type) END AS product_category_name,
               p_size + 1.0::DOUBLE AS product_name_lenght,
               p_size + 2.0::DOUBLE AS product_description_lenght,
               p_size + 3.0::DOUBLE AS product_photos_qty,
               CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE END AS product_weight_g,
               p_size + 4.0::DOUBLE AS product_length_cm,
               p_size + 5.0::DOUBLE AS product_height_cm,
               p_size + 6.0::DOUBLE AS product_width_cm
        FROM part""",
    "raw_translation": """
        SELECT DISTINCT lower(p_type) AS product_category_name,
               CASE WHEN p_type <> 'PROMO' THEN 'en_' || lower(p_type) END
                   AS product_category_name_english
        FROM part WHERE p_type <> 'STANDARD'""",
    "raw_mql": """
        SELECT CAST(event_id AS VARCHAR) AS mql_id,
               strftime(ts, '%Y-%m-%d') AS first_contact_date,
               CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS landing_page_id,
               CASE WHEN event_id % 7 <> 0 THEN 'origin_' || (event_id % 3) END AS origin
        FROM events WHERE event_type = 'signup'""",
    "raw_deals": """
        SELECT CAST(event_id AS VARCHAR) AS mql_id, CAST(event_id % ns AS VARCHAR) AS seller_id,
               CASE WHEN event_id % 12 <> 0
                    THEN strftime(ts + to_days(10), '%Y-%m-%d %H:%M:%S') END AS won_date,
               CASE WHEN event_id % 3 <> 0 THEN 'segment_' || (event_id % 4) END
                   AS business_segment,
               CASE WHEN event_id % 5 <> 0 THEN 'lead_' || (event_id % 4) END AS lead_type,
               CASE WHEN event_id % 7 <> 0 THEN 'profile_' || (event_id % 4) END
                   AS lead_behaviour_profile,
               CASE WHEN event_id % 11 <> 0 THEN 'business_' || (event_id % 4) END
                   AS business_type,
               CASE WHEN event_id % 9 <> 0 THEN (event_id % 100)::DOUBLE END
                   AS declared_product_catalog_size,
               CASE WHEN event_id % 10 <> 0 THEN (event_id % 1000)::DOUBLE END
                   AS declared_monthly_revenue
        FROM events, cfg WHERE event_type = 'signup' AND event_id % 4 = 0""",
}

# --- enrichment and null policy -------------------------------------------------------------

# The delay words appear once, as one pattern.
DELAY_PATTERN = (
    "atraso|atrasado|demorou|demora|tardou|tarde|delayed|late|slow|waiting|waited|never arrived"
)

CURATED = {
    # orders with parsed moments and durations, before missing values are replaced
    "timed": """
        SELECT *, round(total_delivery_days - estimated_days, 1) AS delay_days FROM (
            SELECT r.*, purchase_ts, approved_ts, carrier_ts, customer_ts, estimated_ts,
                round(epoch(approved_ts - purchase_ts) / 3600, 1) AS approval_time_hours,
                round(epoch(carrier_ts - approved_ts) / 86400, 1) AS seller_processing_days,
                round(epoch(customer_ts - carrier_ts) / 86400, 1) AS carrier_delivery_days,
                round(epoch(customer_ts - purchase_ts) / 86400, 1) AS total_delivery_days,
                round(epoch(estimated_ts - purchase_ts) / 86400, 1) AS estimated_days,
                CASE WHEN order_status = 'delivered' AND customer_ts > estimated_ts
                     THEN 1 ELSE 0 END AS is_late,
                strftime(purchase_ts, '%Y-%m') AS order_month,
                CAST(year(purchase_ts) AS INTEGER) AS order_year
            FROM (SELECT *,
                    TRY_CAST(order_purchase_timestamp AS TIMESTAMP) AS purchase_ts,
                    TRY_CAST(order_approved_at AS TIMESTAMP) AS approved_ts,
                    TRY_CAST(order_delivered_carrier_date AS TIMESTAMP) AS carrier_ts,
                    TRY_CAST(order_delivered_customer_date AS TIMESTAMP) AS customer_ts,
                    TRY_CAST(order_estimated_delivery_date AS TIMESTAMP) AS estimated_ts
                  FROM raw_orders) r)""",
    "c_orders": """
        SELECT order_id, customer_id, order_status, order_purchase_timestamp,
               coalesce(order_approved_at, '') AS order_approved_at,
               coalesce(order_delivered_carrier_date, '') AS order_delivered_carrier_date,
               coalesce(order_delivered_customer_date, '') AS order_delivered_customer_date,
               order_estimated_delivery_date,
               coalesce(approval_time_hours, 0) AS approval_time_hours,
               coalesce(seller_processing_days, 0) AS seller_processing_days,
               coalesce(carrier_delivery_days, 0) AS carrier_delivery_days,
               coalesce(total_delivery_days, 0) AS total_delivery_days,
               coalesce(estimated_days, 0) AS estimated_days,
               coalesce(delay_days, 0) AS delay_days,
               is_late, order_month, coalesce(order_year, 0) AS order_year
        FROM timed""",
    # items with every lookup, before missing values are replaced
    "looked_up": """
        SELECT i.*, o.customer_id, o.order_status, o.order_purchase_timestamp,
               c.customer_state, c.customer_city, s.seller_state, s.seller_city,
               p.product_category_name, t.product_category_name_english
        FROM raw_items i
        LEFT JOIN raw_orders o USING (order_id)
        LEFT JOIN raw_customers c ON c.customer_id = o.customer_id
        LEFT JOIN raw_sellers s ON s.seller_id = i.seller_id
        LEFT JOIN raw_products p ON p.product_id = i.product_id
        LEFT JOIN raw_translation t ON t.product_category_name = p.product_category_name""",
    "c_items": """
        SELECT order_id, order_item_id, product_id,
               coalesce(product_category_name_english, product_category_name, 'unknown')
                   AS category,
               seller_id, coalesce(seller_state, 'unknown') AS seller_state,
               coalesce(seller_city, 'unknown') AS seller_city, customer_id,
               coalesce(customer_state, 'unknown') AS customer_state,
               coalesce(customer_city, 'unknown') AS customer_city, order_status, price,
               freight_value, shipping_limit_date,
               CASE WHEN seller_state = customer_state THEN 1 ELSE 0 END AS is_same_state,
               order_purchase_timestamp
        FROM looked_up""",
    # reviews with delivery context and flags, before missing values are replaced
    "flagged": f"""
        SELECT r.*, t.order_status, t.total_delivery_days, t.estimated_days, t.delay_days,
               t.is_late, t.seller_processing_days, t.carrier_delivery_days, t.order_month,
               CASE WHEN review_score <= 2 AND t.is_late = 1 THEN 1 ELSE 0 END
                   AS is_delivery_complaint,
               CASE WHEN regexp_matches(lower(review_comment_message), '{DELAY_PATTERN}')
                    THEN 1 ELSE 0 END AS comment_has_delay_keyword
        FROM raw_reviews r LEFT JOIN timed t USING (order_id)""",
    "c_reviews": """
        SELECT review_id, order_id, review_score,
               coalesce(review_comment_title, '') AS review_comment_title,
               coalesce(review_comment_message, '') AS review_comment_message,
               review_creation_date, review_answer_timestamp,
               coalesce(order_status, 'unknown') AS order_status,
               coalesce(total_delivery_days, 0) AS total_delivery_days,
               coalesce(estimated_days, 0) AS estimated_days,
               coalesce(delay_days, 0) AS delay_days, coalesce(is_late, 0) AS is_late,
               coalesce(seller_processing_days, 0) AS seller_processing_days,
               coalesce(carrier_delivery_days, 0) AS carrier_delivery_days,
               coalesce(order_month, 'unknown') AS order_month,
               is_delivery_complaint, comment_has_delay_keyword
        FROM flagged""",
    "c_products": """
        SELECT coalesce(product_id, 'unknown') AS product_id,
               coalesce(product_category_name, 'unknown') AS product_category_name,
               coalesce(product_name_lenght, 0) AS product_name_lenght,
               coalesce(product_description_lenght, 0) AS product_description_lenght,
               coalesce(product_photos_qty, 0) AS product_photos_qty,
               coalesce(product_weight_g, 0) AS product_weight_g,
               coalesce(product_length_cm, 0) AS product_length_cm,
               coalesce(product_height_cm, 0) AS product_height_cm,
               coalesce(product_width_cm, 0) AS product_width_cm
        FROM raw_products""",
    "c_mql": """
        SELECT mql_id, first_contact_date, coalesce(landing_page_id, '') AS landing_page_id,
               coalesce(origin, 'unknown') AS origin
        FROM raw_mql""",
    "c_deals": """
        SELECT mql_id, seller_id, coalesce(won_date, '') AS won_date,
               coalesce(business_segment, 'unknown') AS business_segment,
               coalesce(lead_type, 'unknown') AS lead_type,
               coalesce(lead_behaviour_profile, 'unknown') AS lead_behaviour_profile,
               coalesce(business_type, 'unknown') AS business_type,
               coalesce(declared_product_catalog_size, 0) AS declared_product_catalog_size,
               coalesce(declared_monthly_revenue, 0) AS declared_monthly_revenue
        FROM raw_deals""",
    "c_translation": """
        SELECT coalesce(product_category_name, 'unknown') AS product_category_name,
               coalesce(product_category_name_english, 'unknown')
                   AS product_category_name_english
        FROM raw_translation""",
    "c_geo": """
        SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng,
               coalesce(geolocation_city, 'unknown') AS geolocation_city,
               coalesce(geolocation_state, 'unknown') AS geolocation_state
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY geolocation_zip_code_prefix
                  ORDER BY geolocation_lat NULLS FIRST, geolocation_lng NULLS FIRST,
                           geolocation_city NULLS FIRST, geolocation_state NULLS FIRST) AS rn
              FROM raw_geo)
        WHERE rn = 1""",
    # whole tenths and cents, so that sums are exact in any order
    "ord": """
        SELECT order_id, order_status, is_late, order_month, order_year,
               CAST(round(seller_processing_days * 10) AS BIGINT) AS proc,
               CAST(round(carrier_delivery_days * 10) AS BIGINT) AS carr,
               CAST(round(total_delivery_days * 10) AS BIGINT) AS tot
        FROM c_orders""",
    "itm": """
        SELECT order_id, seller_id, seller_state, seller_city, customer_state,
               CAST(round(price * 100) AS BIGINT) AS price_c,
               CAST(round(freight_value * 100) AS BIGINT) AS freight_c
        FROM c_items""",
    # the literal joins, one row per order, item and review
    "oi": "SELECT * FROM ord JOIN itm USING (order_id)",
    "oir": """
        SELECT oi.*, r.review_score AS score
        FROM oi LEFT JOIN c_reviews r ON r.order_id = oi.order_id""",
}

COMMON = {**RAW, **CURATED}


def with_tables(body: str) -> str:
    """The query with exactly the derivations it needs, in order of dependence."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        words |= {w.split(".")[0] for w in words}
        for name in COMMON:
            if name in words and name not in needed:
                needed.add(name)
                visit(COMMON[name])

    visit(body)
    body = body.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({COMMON[n]})" for n in COMMON if n in needed)
    own = body.removeprefix("WITH ")
    return f"WITH {ctes}{',' if own != body else ''}\n{own}"


# --- pieces of SQL --------------------------------------------------------------------------


def half_up(value: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"floor(({value}) * {scale} + 0.5::DOUBLE) / {scale}"


def pct(part: str, whole: str) -> str:
    return f"(({part})::DOUBLE * 100.0::DOUBLE / nullif(({whole})::DOUBLE, 0))"


def days(column: str) -> str:
    return f"(sum({column})::DOUBLE / (nullif(count({column}), 0)::DOUBLE * 10.0::DOUBLE))"


def money(value: str) -> str:
    return f"(({value})::DOUBLE / 100.0::DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


ORDERS_SEEN = "count(DISTINCT order_id)"
LATE_SEEN = "count(DISTINCT order_id) FILTER (WHERE is_late = 1)"
LATE_FREIGHT = "sum(CASE is_late WHEN 1 THEN freight_c ELSE 0 END)"
SCORE = half_up("sum(score)::DOUBLE / nullif(count(score), 0)::DOUBLE", 2)
ONE_STAR = "count(*) FILTER (WHERE score = 1)"
ROW_LATE = pct("sum(is_late)", "count(*)")


def sla(value: str, names: tuple[str, ...]) -> str:
    a, b, c, d = names
    return (
        f"CASE WHEN {value} <= 1 THEN '{a}' WHEN {value} <= 3 THEN '{b}' "
        f"WHEN {value} <= 7 THEN '{c}' ELSE '{d}' END"
    )


SLA_NAMES = ("Fast", "Normal", "Slow", "Critical")
SLA_RANGES = ("Fast (≤1 hari)", "Normal (1-3 hari)", "Slow (3-7 hari)", "Critical (>7 hari)")
