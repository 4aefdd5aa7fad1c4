"""Registered queries: one per operator, curated table and report, each with its oracle.

Every query runs over whole tables. A case is a function of the raw tables and the curated
tables; its SQL is completed by `oracle.with_tables`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture import RawTables, read
from checks.oracle import (
    LATE_SEEN,
    ONE_STAR,
    ORDERS_SEEN,
    ROW_LATE,
    SCORE,
    SLA_NAMES,
    big,
    days,
    half_up as sql_half_up,
    money,
    pct,
    sla,
    with_tables,
)
from checks.report_sql import CAUSE, REPORT_SQL, ROUTE
from parcelwatch.functions import bands, clocks, texts
from parcelwatch.functions.numbers import amount, cents, half_up, mean_of_tenths, percent, tenths
from parcelwatch.operators.enrich import (
    enrich_items,
    enrich_orders,
    enrich_reviews,
    order_context,
    with_category,
)
from parcelwatch.operators.fanout import group_measures, order_groups
from parcelwatch.operators.shares import Totals
from parcelwatch.params import Params
from parcelwatch.plans import reports
from parcelwatch.plans.curated import Warehouse, clean_lake, lake_tables, refresh
from parcelwatch.plans.ingest import ingest
from parcelwatch.schemas import ORDER_ITEMS, ORDER_REVIEWS, ORDERS, TABLES
from parcelwatch.session import configure, shared_dir
from parcelwatch.sources.tables import current, read_table, write_table


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str
    raw: RawTables
    wh: Warehouse


CASES: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}
P = Params()


def case(key: str, sql: str | None = None):
    def register(run: Callable[[Inputs], DataFrame]):
        CASES[key] = run
        if sql is not None:
            SQL[key] = with_tables(sql)
        return run

    return register


@lru_cache(maxsize=8)
def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    raw = RawTables(configure(spark), sf_dir)
    return Inputs(spark, sf_dir, raw, Warehouse.computed(raw))


def run_case(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CASES[key](inputs(spark, sf_dir))

    return query


# --- sources and sinks ----------------------------------------------------------------------


@case("op_normalise_columns", "SELECT * FROM raw_customers")
def _(t: Inputs) -> DataFrame:
    odd = [f" {name.replace('_', ' ').title()} " for name in t.raw["customers"].columns]
    return texts.normalise_columns(t.raw["customers"].toDF(*odd))


RAW_NAMES = {
    "orders": "raw_orders",
    "order_items": "raw_items",
    "order_payments": "raw_payments",
    "order_reviews": "raw_reviews",
    "customers": "raw_customers",
    "products": "raw_products",
    "sellers": "raw_sellers",
    "geolocation": "raw_geo",
    "mql": "raw_mql",
    "closed_deals": "raw_deals",
    "category_translation": "raw_translation",
}


@case(
    "op_table_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {cte}"
        for t, cte in RAW_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    counts = None
    for table in TABLES:
        one = t.raw[table].agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@case(
    "op_scan_prune",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
)
def _(t: Inputs) -> DataFrame:
    orders = read(t.spark, t.sf_dir, "orders")
    wanted = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return orders.filter(wanted).select("o_orderkey", "o_totalprice")


@case("op_publish_roundtrip", "SELECT * FROM c_orders")
def _(t: Inputs) -> DataFrame:
    root = f"{shared_dir(t.spark)}/roundtrip-{uuid.uuid4().hex}"
    orders = t.wh.table("orders")
    for _ in range(2):  # a second refresh must not change anything
        write_table(orders, root, "orders", ("order_month", "order_id"))
    return read_table(t.spark, root, "orders")


# --- orders: projections --------------------------------------------------------------------

MOMENTS = (clocks.PURCHASED, clocks.APPROVED, clocks.HANDED_OVER, clocks.ARRIVED, clocks.PROMISED)


@case(
    "op_parse_timestamps",
    """SELECT order_id, purchase_ts, approved_ts, carrier_ts, customer_ts, estimated_ts
       FROM timed""",
)
def _(t: Inputs) -> DataFrame:
    names = ("purchase_ts", "approved_ts", "carrier_ts", "customer_ts", "estimated_ts")
    parsed = [clocks.moment(c).alias(name) for c, name in zip(MOMENTS, names, strict=True)]
    return t.raw["orders"].select("order_id", *parsed)


@case(
    "op_stage_durations",
    """SELECT order_id, approval_time_hours, seller_processing_days, carrier_delivery_days,
              total_delivery_days, estimated_days, delay_days FROM timed""",
)
def _(t: Inputs) -> DataFrame:
    stages = [v.alias(k) for k, v in clocks.durations().items()]
    return t.raw["orders"].select("order_id", *stages)


@case("op_late_flag", "SELECT order_id, is_late FROM timed")
def _(t: Inputs) -> DataFrame:
    return t.raw["orders"].select("order_id", clocks.late_flag(P.delivered).alias("is_late"))


@case("op_order_month", "SELECT order_id, order_month, order_year FROM timed")
def _(t: Inputs) -> DataFrame:
    return t.raw["orders"].select(
        "order_id",
        clocks.purchase_month().alias("order_month"),
        clocks.purchase_year().alias("order_year"),
    )


@case("enrich_orders", f"SELECT {', '.join(ORDERS)} FROM timed")
def _(t: Inputs) -> DataFrame:
    return enrich_orders(t.raw["orders"])


# --- items: projections and joins -----------------------------------------------------------


@case(
    "op_category_label",
    """SELECT product_id,
              coalesce(product_category_name_english, p.product_category_name, 'unknown')
                  AS category
       FROM raw_products p LEFT JOIN raw_translation t
         ON t.product_category_name = p.product_category_name""",
)
def _(t: Inputs) -> DataFrame:
    products = t.raw["products"].select("product_id", "product_category_name")
    return with_category(products, t.raw["category_translation"])


def _items(t: Inputs, *columns: str) -> DataFrame:
    names = ("order_items", "orders", "customers", "sellers", "products", "category_translation")
    return enrich_items(*[t.raw[n] for n in names], columns=columns or ORDER_ITEMS)


@case(
    "op_same_state",
    """SELECT order_id, order_item_id, product_id, seller_id,
              CASE WHEN seller_state = customer_state THEN 1 ELSE 0 END AS is_same_state
       FROM looked_up""",
)
def _(t: Inputs) -> DataFrame:
    keys = ("order_id", "order_item_id", "product_id", "seller_id")
    return _items(t, *keys, "is_same_state")


ENRICHED_ITEMS = """
    SELECT order_id, order_item_id, product_id,
           coalesce(product_category_name_english, product_category_name, 'unknown') AS category,
           seller_id, seller_state, seller_city, customer_id, customer_state, customer_city,
           order_status, price, freight_value, shipping_limit_date,
           CASE WHEN seller_state = customer_state THEN 1 ELSE 0 END AS is_same_state,
           order_purchase_timestamp
    FROM looked_up"""


@case("enrich_items", ENRICHED_ITEMS)
def _(t: Inputs) -> DataFrame:
    return _items(t)


@case(
    "op_join_items_orders",
    """SELECT i.order_id, order_item_id, product_id, customer_id, order_status,
              order_purchase_timestamp
       FROM raw_items i LEFT JOIN raw_orders r ON r.order_id = i.order_id""",
)
def _(t: Inputs) -> DataFrame:
    context = order_context(
        t.raw["orders"], t.raw["customers"], ("order_status", "order_purchase_timestamp")
    )
    items = t.raw["order_items"].select("order_id", "order_item_id", "product_id")
    return items.join(context, "order_id", "left")


@case(
    "op_join_dims",
    """SELECT order_id, order_item_id, product_id, seller_id, seller_state, seller_city,
              customer_id, customer_state, customer_city,
              coalesce(product_category_name_english, product_category_name, 'unknown')
                  AS category
       FROM looked_up""",
)
def _(t: Inputs) -> DataFrame:
    keys = ("order_id", "order_item_id", "product_id", "seller_id", "customer_id")
    places = ("seller_state", "seller_city", "customer_state", "customer_city")
    return _items(t, *keys, *places, "category")


# --- reviews: projections and joins ---------------------------------------------------------


def _reviews(t: Inputs, params: Params = P) -> DataFrame:
    return enrich_reviews(t.raw["order_reviews"], enrich_orders(t.raw["orders"]), params)


@case("enrich_reviews", f"SELECT {', '.join(ORDER_REVIEWS)} FROM flagged")
def _(t: Inputs) -> DataFrame:
    return _reviews(t)


@case(
    "op_join_reviews_orders",
    """SELECT review_id, order_id, order_status, total_delivery_days, estimated_days,
              delay_days, is_late, seller_processing_days, carrier_delivery_days, order_month
       FROM flagged""",
)
def _(t: Inputs) -> DataFrame:
    return _reviews(t).select(
        "review_id",
        "order_id",
        "order_status",
        "total_delivery_days",
        "estimated_days",
        "delay_days",
        "is_late",
        "seller_processing_days",
        "carrier_delivery_days",
        "order_month",
    )


@case("op_delivery_complaint", "SELECT review_id, is_delivery_complaint FROM flagged")
def _(t: Inputs) -> DataFrame:
    return _reviews(t).select("review_id", "is_delivery_complaint")


@case("op_delay_keyword", "SELECT review_id, comment_has_delay_keyword FROM flagged")
def _(t: Inputs) -> DataFrame:
    found = texts.mentions(F.col("review_comment_message"), P.delay_keywords)
    return t.raw["order_reviews"].select("review_id", found.alias("comment_has_delay_keyword"))


@case(
    "op_delay_keyword_words",
    r"""SELECT review_id,
               CASE WHEN regexp_matches(lower(review_comment_message),
                        '\b(atraso|atrasado|demorou|demora|tardou|tarde|delayed|late|slow|'
                        || 'waiting|waited|never arrived)\b') THEN 1 ELSE 0 END
                   AS comment_has_delay_keyword
        FROM raw_reviews""",
)
def _(t: Inputs) -> DataFrame:
    found = texts.mentions(F.col("review_comment_message"), P.delay_keywords, whole_words=True)
    return t.raw["order_reviews"].select("review_id", found.alias("comment_has_delay_keyword"))


# --- filters --------------------------------------------------------------------------------

FROM_ORDERS = "order_id, order_status, order_month, is_late"


@case(
    "op_filter_delivered",
    f"SELECT {FROM_ORDERS} FROM c_orders WHERE order_status = 'delivered'",
)
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", *FROM_ORDERS.split(", "))
    return orders.filter(F.col("order_status") == P.delivered)


@case(
    "op_filter_in",
    f"""SELECT {FROM_ORDERS}, seller_processing_days FROM c_orders
        WHERE order_status IN ('delivered', 'shipped') AND seller_processing_days >= 0""",
)
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", *FROM_ORDERS.split(", "), "seller_processing_days")
    moving = F.col("order_status").isin(*P.moving)
    return orders.filter(moving & (F.col("seller_processing_days") >= 0))


@case(
    "op_having",
    f"""SELECT seller_id, {ORDERS_SEEN} AS orders, {LATE_SEEN} AS late_orders
        FROM oi WHERE order_status = 'delivered' GROUP BY seller_id
        HAVING {ORDERS_SEEN} >= 50 AND {days('proc')} > 2
           AND {pct(LATE_SEEN, ORDERS_SEEN)} > 20""",
)
def _(t: Inputs) -> DataFrame:
    sellers = _seller_groups(t, "orders", "late_orders", *reports.stage_columns(PROCESSING))
    return sellers.filter(
        (F.col("orders") >= P.min_orders)
        & (reports.mean_days(PROCESSING) > P.slow_days)
        & (reports.late_order_pct() > P.late_pct)
    ).select("seller_id", "orders", "late_orders")


# --- joins of the facts ---------------------------------------------------------------------

PROCESSING, CARRIER, TOTAL = reports.PROCESSING, reports.CARRIER, reports.TOTAL


def _delivered(t: Inputs) -> DataFrame:
    columns = ("order_id", "order_status", "is_late", PROCESSING, CARRIER, TOTAL)
    return t.wh.table("orders", *columns).filter(F.col("order_status") == P.delivered)


def _facts(t: Inputs, *keys: str) -> DataFrame:
    return t.wh.facts(*keys).filter(F.col("order_status") == P.delivered)


def _seller_groups(t: Inputs, *measures: str, reviews: bool = False) -> DataFrame:
    groups = order_groups(_facts(t, "seller_id"), ["seller_id"], reviews)
    return group_measures(groups, ["seller_id"], measures)


@case(
    "op_join_orders_items",
    """SELECT order_id, order_item_id, product_id, seller_id, price, is_late
       FROM c_orders JOIN (SELECT order_id, order_item_id, product_id, seller_id, price
                           FROM c_items) USING (order_id)
       WHERE order_status = 'delivered'""",
)
def _(t: Inputs) -> DataFrame:
    columns = ("order_id", "order_item_id", "product_id", "seller_id", "price")
    return (
        t.wh.table("order_items", *columns)
        .join(_delivered(t), "order_id")
        .select(*columns, "is_late")
    )


FAN_SUMS = {
    "rows": "count(*)",
    "late_rows": "sum(is_late)",
    "orders": ORDERS_SEEN,
    "late_orders": LATE_SEEN,
    "price_cents": "sum(price_c)",
    "freight_cents": "sum(freight_c)",
    "late_freight_cents": "sum(CASE is_late WHEN 1 THEN freight_c ELSE 0 END)",
    "seller_processing_days_tenths": "sum(proc)",
    "seller_processing_days_n": "count(proc)",
    "total_delivery_days_tenths": "sum(tot)",
    "score_sum": "sum(score)",
    "scores": "count(score)",
    "one_star": ONE_STAR,
}


@case(
    "op_join_fanout",
    "SELECT seller_id, "
    + ", ".join(f'{big(v)} AS "{k}"' for k, v in FAN_SUMS.items())
    + " FROM oir WHERE order_status = 'delivered' GROUP BY seller_id",
)
def _(t: Inputs) -> DataFrame:
    return _seller_groups(t, *FAN_SUMS, reviews=True)


# --- aggregations ---------------------------------------------------------------------------


@case("agg_count", "SELECT order_status, count(*) AS orders FROM c_orders GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return t.wh.table("orders", "order_status").groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders")
    )


@case(
    "agg_count_distinct",
    "SELECT customer_state, count(DISTINCT order_id) AS orders FROM c_items GROUP BY 1",
)
def _(t: Inputs) -> DataFrame:
    items = t.wh.table("order_items", "order_id", "customer_state")
    return items.groupBy("customer_state").agg(F.count_distinct("order_id").alias("orders"))


@case(
    "agg_count_distinct_if",
    """SELECT order_month, count(DISTINCT CASE WHEN is_late = 1 THEN order_id END) AS late_orders,
              count(DISTINCT order_id) AS orders
       FROM c_orders GROUP BY order_month""",
)
def _(t: Inputs) -> DataFrame:
    # one row per month and order first: two distinct counts at once would copy every row
    orders = t.wh.table("orders", "order_month", "order_id", "is_late")
    once = orders.groupBy("order_month", "order_id").agg(F.max("is_late").alias("late"))
    return once.groupBy("order_month").agg(
        F.sum("late").cast("bigint").alias("late_orders"), F.count("order_id").alias("orders")
    )


@case(
    "agg_sum",
    f"SELECT seller_id, {money('sum(price_c)')} AS revenue FROM itm GROUP BY seller_id",
)
def _(t: Inputs) -> DataFrame:
    items = t.wh.table("order_items", "seller_id", "price")
    return items.groupBy("seller_id").agg(amount(F.sum(cents("price"))).alias("revenue"))


@case(
    "agg_sum_if",
    f"""SELECT seller_id,
               {money('sum(CASE WHEN is_late = 1 THEN freight_c ELSE 0 END)')} AS late_freight
        FROM oi GROUP BY seller_id""",
)
def _(t: Inputs) -> DataFrame:
    items = t.wh.table("order_items", "order_id", "seller_id", "freight_value")
    orders = t.wh.table("orders", "order_id", "is_late")
    late_freight = F.when(F.col("is_late") == 1, cents("freight_value")).otherwise(0)
    return (
        items.join(orders, "order_id")
        .groupBy("seller_id")
        .agg(amount(F.sum(late_freight)).alias("late_freight"))
    )


@case(
    "agg_avg",
    f"""SELECT order_month, {days('proc')} AS avg_processing, {days('tot')} AS avg_total
        FROM ord GROUP BY order_month""",
)
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", "order_month", PROCESSING, TOTAL)
    grouped = orders.groupBy("order_month").agg(*reports.sum_and_count(PROCESSING, TOTAL))
    return grouped.select(
        "order_month",
        reports.mean_days(PROCESSING).alias("avg_processing"),
        reports.mean_days(TOTAL).alias("avg_total"),
    )


@case(
    "agg_max",
    """SELECT order_month, max(seller_processing_days) AS max_processing,
              max(carrier_delivery_days) AS max_carrier
       FROM c_orders GROUP BY order_month""",
)
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", "order_month", PROCESSING, CARRIER)
    return orders.groupBy("order_month").agg(
        F.max(PROCESSING).alias("max_processing"), F.max(CARRIER).alias("max_carrier")
    )


@case(
    "agg_percentile",
    f"""SELECT order_month, {sql_half_up("quantile_cont(tot, 0.5) / 10.0::DOUBLE", 1)} AS p50,
               {sql_half_up("quantile_cont(tot, 0.9) / 10.0::DOUBLE", 1)} AS p90
        FROM ord WHERE order_status = 'delivered' GROUP BY order_month""",
)
def _(t: Inputs) -> DataFrame:
    histogram = (
        t.wh.table("orders", "order_status", "order_month", TOTAL)
        .filter(F.col("order_status") == P.delivered)
        .groupBy("order_month", tenths(TOTAL).alias("tenths"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    p50, p90 = (F.percentile("tenths", q, F.col("n")) / 10.0 for q in P.quantiles)
    return histogram.groupBy("order_month").agg(
        half_up(p50, 1).alias("p50"), half_up(p90, 1).alias("p90")
    )


@case(
    "agg_late_rate",
    f"""SELECT order_status, {sql_half_up(ROW_LATE, 1)} AS late_pct
        FROM ord GROUP BY order_status""",
)
def _(t: Inputs) -> DataFrame:
    late_pct = percent(F.sum("is_late"), F.count(F.lit(1)))
    orders = t.wh.table("orders", "order_status", "is_late")
    return orders.groupBy("order_status").agg(half_up(late_pct, 1).alias("late_pct"))


@case(
    "agg_safe_ratio",
    f"""SELECT order_status, {sql_half_up(pct('sum(proc)', 'sum(tot)'), 2)} AS processing_pct
        FROM ord GROUP BY order_status""",
)
def _(t: Inputs) -> DataFrame:
    # orders that never arrive have a total of zero: the ratio is missing, not an error
    ratio = percent(F.sum(tenths(PROCESSING)), F.sum(tenths(TOTAL)))
    orders = t.wh.table("orders", "order_status", PROCESSING, TOTAL)
    return orders.groupBy("order_status").agg(half_up(ratio, 2).alias("processing_pct"))


@case(
    "agg_contribution_pct",
    f"""SELECT order_year, {sql_half_up(pct(days('proc'), days('tot')), 1)} AS seller_pct,
               {sql_half_up(pct(days('carr'), days('tot')), 1)} AS carrier_pct
        FROM ord WHERE order_status = 'delivered' GROUP BY order_year""",
)
def _(t: Inputs) -> DataFrame:
    columns = (PROCESSING, CARRIER, TOTAL)
    orders = t.wh.table("orders", "order_status", "order_year", *columns)
    grouped = (
        orders.filter(F.col("order_status") == P.delivered)
        .groupBy("order_year")
        .agg(*reports.sum_and_count(*columns))
    )
    parts = {"seller_pct": PROCESSING, "carrier_pct": CARRIER}
    return grouped.select(
        "order_year",
        *[
            half_up(percent(reports.mean_days(c), reports.mean_days(TOTAL)), 1).alias(name)
            for name, c in parts.items()
        ],
    )


@case(
    "agg_multi_key",
    f"""SELECT seller_id, seller_state, seller_city, {ORDERS_SEEN} AS orders, count(*) AS items
        FROM itm GROUP BY ALL""",
)
def _(t: Inputs) -> DataFrame:
    keys = ("seller_id", "seller_state", "seller_city")
    items = t.wh.table("order_items", "order_id", *keys)
    per_order = items.groupBy(*keys, "order_id").agg(F.count(F.lit(1)).alias("n"))
    return per_order.groupBy(*keys).agg(
        F.count("order_id").alias("orders"), F.sum("n").alias("items")
    )


# --- shares and gaps ------------------------------------------------------------------------


@case(
    "win_share_of_count",
    f"""SELECT category, {sql_half_up(pct('count(*)', 'sum(count(*)) OVER ()'), 2)} AS share_pct
        FROM c_items GROUP BY category""",
)
def _(t: Inputs) -> DataFrame:
    counts = t.wh.table("order_items", "category").groupBy("category").agg(
        F.count(F.lit(1)).alias("n")
    )
    share = half_up(Totals(counts, ("n",)).share("n"), 2)
    return counts.select("category", share.alias("share_pct"))


@case(
    "win_share_of_distinct",
    f"""SELECT customer_state, {LATE_SEEN} AS late_orders,
               {sql_half_up(pct(LATE_SEEN, f'sum({LATE_SEEN}) OVER ()'), 2)} AS share_pct
        FROM oi WHERE order_status = 'delivered' GROUP BY customer_state""",
)
def _(t: Inputs) -> DataFrame:
    keys = ["customer_state"]
    groups = order_groups(_facts(t, *keys), keys, reviews=False)
    states = group_measures(groups, keys, ["late_orders"])
    share = half_up(Totals(states, ("late_orders",)).share("late_orders"), 2)
    return states.select("customer_state", "late_orders", share.alias("share_pct"))


@case(
    "win_gap_to_mean",
    f"""WITH m AS (SELECT order_month, {days('tot')} AS d FROM ord
                   WHERE order_status = 'delivered' GROUP BY order_month)
        SELECT order_month, {sql_half_up('d - avg(d) OVER ()', 1)} AS gap_days FROM m""",
)
def _(t: Inputs) -> DataFrame:
    months = (
        t.wh.table("orders", "order_status", "order_month", TOTAL)
        .filter(F.col("order_status") == P.delivered)
        .groupBy("order_month")
        .agg(*reports.sum_and_count(TOTAL))
    )
    mean = reports.mean_days(TOTAL)
    totals = Totals(months, (f"{TOTAL}_tenths", f"{TOTAL}_n"), {"days": mean})
    return months.select("order_month", half_up(mean - totals.mean("days"), 1).alias("gap_days"))


@case(
    "win_share_of_sum",
    f"""SELECT seller_id,
               {sql_half_up(pct('sum(is_late)', 'sum(sum(is_late)) OVER ()'), 2)} AS share_pct
        FROM oir WHERE order_status = 'delivered' GROUP BY seller_id""",
)
def _(t: Inputs) -> DataFrame:
    sellers = _seller_groups(t, "late_rows", reviews=True)
    share = half_up(Totals(sellers, ("late_rows",)).share("late_rows"), 2)
    return sellers.select("seller_id", share.alias("share_pct"))


# --- sort, limit, set operations ------------------------------------------------------------


@case(
    "sort_custom_rank",
    f"""SELECT sla_category, count(*) AS sellers FROM (
            SELECT {sla(days('proc'), SLA_NAMES)} AS sla_category
            FROM oi WHERE order_status = 'delivered' GROUP BY seller_id)
        GROUP BY sla_category
        ORDER BY list_position(['Fast', 'Normal', 'Slow', 'Critical'], sla_category)""",
)
def _(t: Inputs) -> DataFrame:
    sellers = _seller_groups(t, *reports.stage_columns(PROCESSING))
    category = bands.sla(reports.mean_days(PROCESSING), P)
    rank = bands.first_match(
        [F.col("sla_category") == name for name in bands.SLA_NAMES[:-1]], (1, 2, 3, 4)
    )
    return (
        sellers.groupBy(category.alias("sla_category"))
        .agg(F.count(F.lit(1)).alias("sellers"))
        .orderBy(rank)
    )


@case(
    "topk_sellers",
    f"""SELECT seller_id, {big('sum(is_late)')} AS late_rows FROM oi
        WHERE order_status = 'delivered' GROUP BY seller_id
        ORDER BY late_rows DESC, seller_id LIMIT 20""",
)
def _(t: Inputs) -> DataFrame:
    sellers = _seller_groups(t, "late_rows")
    return sellers.orderBy(F.desc("late_rows"), "seller_id").limit(P.top_losses)


@case(
    "set_union_all",
    f"""SELECT 'seller' AS stage, count(*) AS orders, {days('proc')} AS avg_days FROM ord
        WHERE proc > 0
        UNION ALL
        SELECT 'carrier', count(*), {days('carr')} FROM ord WHERE carr > 0""",
)
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", PROCESSING, CARRIER)

    def one(label: str, stage: str) -> DataFrame:
        n = F.count(F.lit(1))
        mean = mean_of_tenths(F.sum(tenths(stage)), n)
        return orders.filter(F.col(stage) > 0).agg(
            F.lit(label).alias("stage"), n.alias("orders"), mean.alias("avg_days")
        )

    return one("seller", PROCESSING).unionByName(one("carrier", CARRIER))


# --- null policy and deduplication: the filled tables ---------------------------------------

CURATED_NAMES = {
    "orders": "c_orders",
    "order_items": "c_items",
    "order_reviews": "c_reviews",
    "order_payments": "raw_payments",
    "customers": "raw_customers",
    "sellers": "raw_sellers",
    "products": "c_products",
    "mql": "c_mql",
    "closed_deals": "c_deals",
    "category_translation": "c_translation",
    "geolocation": "c_geo",
}

# Per policy: its table, the filled columns and what counts as filled, by group.
POLICIES = {
    "orders": ("orders", ("order_approved_at", "order_delivered_carrier_date", PROCESSING)),
    "items": ("order_items", ("category", "seller_state", "customer_state")),
    "reviews": ("order_reviews", ("review_comment_title", "review_comment_message", TOTAL)),
    "products": ("products", ("product_category_name", "product_weight_g")),
    "mql": ("mql", ("origin", "landing_page_id")),
    "deals": ("closed_deals", ("won_date", "business_segment", "declared_monthly_revenue")),
    "category": ("category_translation", ("product_category_name_english",)),
    "geo": ("geolocation", ("geolocation_city", "geolocation_state")),
}


def _register_policy(name: str, table: str, columns: tuple[str, ...]) -> None:
    listed = ", ".join(columns)
    sql = f"SELECT {listed}, count(*) AS n FROM {CURATED_NAMES[table]} GROUP BY {listed}"

    @case(f"null_policy_{name}", sql)
    def _(t: Inputs) -> DataFrame:
        return t.wh.table(table).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


for _name, (_table, _columns) in POLICIES.items():
    _register_policy(_name, _table, _columns)


@case("dedup_geolocation", "SELECT * FROM c_geo")
def _(t: Inputs) -> DataFrame:
    return t.wh.table("geolocation")


# --- classification rules -------------------------------------------------------------------


@case(
    "fn_case_label",
    """SELECT review_id, review_score,
              ['Sangat Buruk', 'Buruk', 'Cukup', 'Baik', 'Sangat Baik'][review_score] AS label
       FROM raw_reviews""",
)
def _(t: Inputs) -> DataFrame:
    label = bands.score_label(F.col("review_score")).alias("label")
    return t.raw["order_reviews"].select("review_id", "review_score", label)


@case(
    "fn_complaint_cause",
    f"SELECT review_id, {CAUSE} AS cause FROM c_reviews",
)
def _(t: Inputs) -> DataFrame:
    flags = ("is_late", "is_delivery_complaint", "comment_has_delay_keyword")
    reviews = t.wh.table("order_reviews", "review_id", *flags)
    return reviews.select("review_id", bands.one_star_cause(*map(F.col, flags)).alias("cause"))


@case(
    "fn_route",
    f"""SELECT order_id, order_item_id, product_id, {ROUTE} AS route FROM c_items""",
)
def _(t: Inputs) -> DataFrame:
    keys = ("order_id", "order_item_id", "product_id")
    items = t.wh.table("order_items", *keys, "seller_state", "customer_state")
    route = bands.route(F.col("seller_state"), F.col("customer_state"), P)
    return items.select(*keys, route.alias("route"))


@case("fn_band_sla", f"SELECT order_id, {sla(PROCESSING, SLA_NAMES)} AS band FROM c_orders")
def _(t: Inputs) -> DataFrame:
    orders = t.wh.table("orders", "order_id", PROCESSING)
    return orders.select("order_id", bands.sla(F.col(PROCESSING), P).alias("band"))


@case(
    "fn_band_volume",
    f"""SELECT seller_id, CASE WHEN n >= 500 THEN 'High Volume' WHEN n >= 100
                               THEN 'Medium Volume' ELSE 'Low Volume' END AS band
        FROM (SELECT seller_id, {ORDERS_SEEN} AS n FROM itm GROUP BY seller_id)""",
)
def _(t: Inputs) -> DataFrame:
    pairs = t.wh.table("order_items", "seller_id", "order_id").distinct()
    sellers = pairs.groupBy("seller_id").agg(F.count("order_id").alias("n"))
    return sellers.select("seller_id", bands.volume(F.col("n"), P).alias("band"))


@case(
    "fn_band_loss",
    """SELECT seller_id, CASE WHEN f > 500000 THEN 'Besar (>5000)'
                              WHEN f > 100000 THEN 'Sedang (1000-5000)'
                              ELSE 'Kecil (<1000)' END AS band
       FROM (SELECT seller_id, sum(freight_c) AS f FROM itm GROUP BY seller_id)""",
)
def _(t: Inputs) -> DataFrame:
    items = t.wh.table("order_items", "seller_id", "freight_value")
    sellers = items.groupBy("seller_id").agg(F.sum(cents("freight_value")).alias("f"))
    return sellers.select("seller_id", bands.freight_loss(amount(F.col("f")), P).alias("band"))


@case(
    "fn_band_priority",
    f"""SELECT seller_id, CASE WHEN d > 7 AND p > 30 THEN 'Intervensi Segera'
                               WHEN d > 3 AND p > 20 THEN 'Perlu Monitoring'
                               ELSE 'Pantau Berkala' END AS band
        FROM (SELECT seller_id, {days('proc')} AS d, {ROW_LATE} AS p FROM oir
              WHERE order_status = 'delivered' GROUP BY seller_id)""",
)
def _(t: Inputs) -> DataFrame:
    measures = ("rows", "late_rows", *reports.stage_columns(PROCESSING))
    sellers = _seller_groups(t, *measures, reviews=True)
    band = bands.priority(reports.mean_days(PROCESSING), reports.late_row_pct(), P)
    return sellers.select("seller_id", band.alias("band"))


# --- curated tables and reports -------------------------------------------------------------


def _register_table(table: str) -> None:
    @case(f"table_{table}", f"SELECT * FROM {CURATED_NAMES[table]}")
    def _(t: Inputs) -> DataFrame:
        return t.wh.table(table)


for _table in TABLES:
    _register_table(_table)


def _register_report(name: str, sql_name: str, **options) -> None:
    @case(f"report_{sql_name}", REPORT_SQL[sql_name])
    def _(t: Inputs) -> DataFrame:
        return reports.REPORTS[name](t.wh, **options)


for _name in reports.REPORTS:
    _register_report(_name, _name)
for _name in reports.PER_ORDER:
    _register_report(_name, f"{_name}_per_order", per_order=True)


# --- the path users take: refresh, publish, read back -----------------------------------------


@lru_cache(maxsize=8)
def _published(spark: SparkSession, sf_dir: str) -> Warehouse:
    root = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    refresh(spark, inputs(spark, sf_dir).raw, root, summaries=True)
    return Warehouse.published(spark, root)


def published(t: Inputs) -> Warehouse:
    """The warehouse of a refresh into the shared folder, made once for each input."""
    return _published(t.spark, t.sf_dir)


def _register_published(name: str, sql_name: str, **options) -> None:
    @case(f"published_{sql_name}", REPORT_SQL[sql_name])
    def _(t: Inputs) -> DataFrame:
        return reports.REPORTS[name](published(t), **options)


for _name in reports.REPORTS:
    _register_published(_name, _name)
for _name in reports.PER_ORDER:
    _register_published(_name, f"{_name}_per_order", per_order=True)


@case(
    "op_tables_by_name",
    """SELECT order_status, count(*) AS n FROM c_orders
       GROUP BY order_status HAVING count(*) > 10""",
)
def _(t: Inputs) -> DataFrame:
    published(t).register(t.spark, "market_")
    return t.spark.sql(
        "SELECT order_status, count(*) AS n FROM market_orders"
        " GROUP BY order_status HAVING count(*) > 10"
    )


def _csv_lake(t: Inputs) -> tuple[str, DataFrame]:
    """The raw tables written as CSV with line breaks in a cell, and ingested again."""
    root = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    for table in TABLES:
        df = t.raw[table]
        if table == "order_reviews":
            broken = F.concat(F.lit('a "b",\n'), F.col("review_comment_message"))
            df = df.withColumn("review_comment_message", broken)
        df.write.csv(f"{root}/in/{table}.csv", header=True, escape='"')
    return f"{root}/lake", ingest(t.spark, f"{root}/in", f"{root}/lake")


@case(
    "op_csv_source",
    """SELECT review_id::VARCHAR AS review_id, order_id::VARCHAR AS order_id, review_score,
              'a "b",' || chr(10) || review_comment_message AS review_comment_message
       FROM raw_reviews""",
)
def _(t: Inputs) -> DataFrame:
    lake, _ = _csv_lake(t)
    reviews = read_table(t.spark, lake, "order_reviews")
    return reviews.select("review_id", "order_id", "review_score", "review_comment_message")


@case(
    "op_ingest_report",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"table\", 'loaded' AS status, count(*) AS \"rows\" FROM {cte}"
        for name, cte in RAW_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    return _csv_lake(t)[1].select("table", "status", "rows")


@case(
    "op_clean_lake",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"table\", '{'kept' if name == 'sellers' else 'gone'}' AS lake,"
        f" count(*) AS \"rows\" FROM {cte}"
        for name, cte in CURATED_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """Refresh from a lake, load sellers anew, clean up: only the new load is left."""
    lake = f"{shared_dir(t.spark)}/lake-{uuid.uuid4().hex}"
    for table in TABLES:
        write_table(t.raw[table], lake, table)
    report = refresh(t.spark, lake_tables(t.spark, lake), f"{lake}-warehouse")
    write_table(t.raw["sellers"], lake, "sellers")
    clean_lake(t.spark, lake, f"{lake}-warehouse")
    left = [(n, "gone" if current(t.spark, f"{lake}/{n}") is None else "kept") for n in TABLES]
    return report.join(t.spark.createDataFrame(left, "table string, lake string"), "table")


from checks import versions  # noqa: E402, F401  registers its cases beside these
