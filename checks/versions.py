"""Cases about published versions: layout, grains, merged counts, differences, loading by file.

Changes are made to the version before: the lake is first loaded with tables that lack some rows,
have others too many and others altered, and then with the given tables. What is read in the end
must be what the given tables say, so the oracles need no altered tables.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.cases import CURATED_NAMES, FAN_SUMS, RAW_NAMES, Inputs, case, inputs, published
from checks.oracle import LATE_SEEN, ORDERS_SEEN, big
from checks.report_sql import DELAY_VS_SCORE, LATE_BY_STATE, ONE_STAR_CAUSES, REPORT_SQL, ROUTE
from parcelwatch.operators.distinct import count_orders
from parcelwatch.operators.grains import GRAINS
from parcelwatch.params import Params
from parcelwatch.plans import reports
from parcelwatch.plans.calendar import months
from parcelwatch.plans.curated import Warehouse, lake_tables, manifest, refresh
from parcelwatch.plans.delta import refresh_changed
from parcelwatch.plans.ingest import ingest
from parcelwatch.plans.sql_reports import register_functions
from parcelwatch.schemas import SORT_KEYS, TABLES
from parcelwatch.session import shared_dir
from parcelwatch.sources import storage
from parcelwatch.sources.tables import current, layout, write_table

P = Params()


def folder(t: Inputs, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def share(column: str, n: int, k: int) -> Column:
    """Whether a key falls into part k of n, by a hash."""
    return F.crc32(F.col(column).cast("binary")) % n == k


# --- facts and grains -----------------------------------------------------------------------

FAN_COLUMNS = ", ".join(f'{big(v)} AS "{k}"' for k, v in FAN_SUMS.items())


@case(
    "op_facts_bucketed",
    f"""SELECT seller_id, seller_state, {FAN_COLUMNS} FROM oir
        WHERE order_status = 'delivered' GROUP BY seller_id, seller_state""",
)
def _(t: Inputs) -> DataFrame:
    """Measures summed from the published facts, which are dealt by order."""
    return published(t).without_grains().measures("seller_state", list(FAN_SUMS), P)


# Per grain its keys and the rows that count for it, in SQL.
DELIVERED = "order_status = 'delivered'"
GRAIN_SQL = {
    "state": ("customer_state", DELIVERED),
    "route": (ROUTE, DELIVERED),
    "seller": ("seller_id", DELIVERED),
    "seller_processed": ("seller_id", f"{DELIVERED} AND proc >= 0"),
    "seller_state": ("seller_id || '/' || seller_state", DELIVERED),
    "seller_place": (
        "seller_id || '/' || seller_state || '/' || seller_city",
        "order_status IN ('delivered', 'shipped') AND proc >= 0",
    ),
}


@case(
    "op_grains",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS grain, {key} AS key, {FAN_COLUMNS} FROM oir WHERE {rows} GROUP BY 2"
        for name, (key, rows) in GRAIN_SQL.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """All published grains, beside a plain GROUP BY each."""
    found = None
    for name, grain in GRAINS.items():
        one = published(t).measures(name, list(FAN_SUMS), P)
        one = one.select(F.lit(name).alias("grain"), F.concat_ws("/", *grain.keys).alias("key"), *FAN_SUMS)
        found = one if found is None else found.unionAll(one)
    return found


# --- counts and quantiles that are merged ---------------------------------------------------

MERGED_BY = {"month": ("order_month",), "seller_state": ("seller_state",), "route": ("seller_state", "customer_state"), "all": ()}


@case(
    "agg_count_distinct_merged",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS grouping, {" || '/' || ".join(keys) or "''"} AS value,
                   {ORDERS_SEEN} AS orders, {LATE_SEEN} AS late_orders FROM oi GROUP BY 2"""
        for name, keys in MERGED_BY.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """Distinct orders of four groupings, merged from one set of bitmaps."""
    found = None
    for name, keys in MERGED_BY.items():
        one = count_orders(published(t).bitmaps(), keys)
        one = one.select(F.lit(name).alias("grouping"), F.concat_ws("/", *keys).alias("value"), "orders", "late_orders")
        found = one if found is None else found.unionAll(one)
    return found


RANKS = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS component, q, count(*) AS n, true AS within
        FROM ord, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS q)
        WHERE order_status = 'delivered' AND {column} > 0 GROUP BY q"""
    for name, column in (("seller_processing_days", "proc"), ("carrier_delivery_days", "carr"))
)


@case("agg_percentile_merged", RANKS)
def _(t: Inputs) -> DataFrame:
    return reports.check_merged_quantiles(published(t))


@case("agg_percentile_approx", RANKS)
def _(t: Inputs) -> DataFrame:
    return reports.check_approximate_quantiles(t.wh)


# --- refresh by difference ------------------------------------------------------------------


def _before(t: Inputs) -> dict[str, DataFrame]:
    """The tables as they might have been a day ago: rows too few, too many and altered."""
    raw = dict(t.raw)
    orders, items, reviews = (raw[n] for n in ("orders", "order_items", "order_reviews"))

    def dropped(df: DataFrame) -> DataFrame:
        return df.filter(~share("order_id", 50, 0))

    def doubled(df: DataFrame) -> DataFrame:
        gone = df.filter(share("order_id", 50, 1))
        return df.unionAll(gone.withColumn("order_id", F.concat(F.lit("gone-"), F.col("order_id"))))

    status = F.when(share("order_id", 50, 2), "shipped").otherwise(F.col("order_status"))
    raw["orders"] = doubled(dropped(orders.withColumn("order_status", status)))
    price = F.when(share("order_id", 50, 3), F.col("price") + 1).otherwise(F.col("price"))
    raw["order_items"] = doubled(dropped(items.withColumn("price", price)))
    raw["order_reviews"] = doubled(dropped(reviews).filter(~share("review_id", 60, 4)))
    state = F.when(share("customer_id", 90, 5), "XX").otherwise(F.col("customer_state"))
    raw["customers"] = raw["customers"].withColumn("customer_state", state)
    city = F.when(share("seller_id", 40, 6), "elsewhere").otherwise(F.col("seller_city"))
    raw["sellers"] = raw["sellers"].withColumn("seller_city", city)
    return raw


@lru_cache(maxsize=8)
def _changed(spark: SparkSession, sf_dir: str) -> Warehouse:
    t = inputs(spark, sf_dir)
    lake = folder(t, "delta")
    before = _before(t)
    for table in TABLES:
        write_table(before[table], lake, table)
    refresh(spark, lake_tables(spark, lake), f"{lake}-warehouse")
    for table in ("orders", "order_items", "order_reviews", "customers", "sellers"):
        write_table(t.raw[table], lake, table)
    refresh_changed(spark, lake_tables(spark, lake), f"{lake}-warehouse")
    return Warehouse.published(spark, f"{lake}-warehouse")


@case(
    "op_refresh_delta",
    f"SELECT seller_id, seller_state, seller_city, {FAN_COLUMNS} FROM oir WHERE"
    " order_status IN ('delivered', 'shipped') AND proc >= 0 GROUP BY seller_id, seller_state, seller_city",
)
def _(t: Inputs) -> DataFrame:
    """Measures after a refresh by difference: taken away as they were, added as they are."""
    return _changed(t.spark, t.sf_dir).measures("seller_place", list(FAN_SUMS), P)


def _register_changed(table: str) -> None:
    @case(f"op_refresh_delta_{table}", f"SELECT * FROM {CURATED_NAMES[table]}")
    def _(t: Inputs) -> DataFrame:
        return _changed(t.spark, t.sf_dir).table(table)


for _table in ("orders", "order_items", "order_reviews", "customers", "products"):
    _register_changed(_table)


# --- loading by file ------------------------------------------------------------------------

FILE_TABLES = ("sellers", "customers")


def _write_parts(df: DataFrame, path: str, key: str, parts: list[int]) -> None:
    """One CSV file for each named quarter of the keys."""
    for k in parts:
        df.filter(share(key, 4, k)).coalesce(1).write.mode("append").csv(path, header=True, escape='"')


@case(
    "op_ingest_again",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", '{status}' AS status, {rows} AS "rows", {loaded} AS files_loaded,
                   {same} AS files_unchanged, {removed} AS files_removed FROM {RAW_NAMES[name]}"""
        for name, status, rows, loaded, same, removed in (
            ("sellers", "loaded", "count(*)", 2, 2, 1),
            ("customers", "unchanged", "count(*)", 0, 4, 0),
        )
    ),
)
def _(t: Inputs) -> DataFrame:
    """Sellers come in four files; one of them arrived in two halves, which are replaced by two others."""
    root = folder(t, "again")
    source, lake = f"{root}/in", f"{root}/lake"
    sellers, path = t.raw["sellers"], f"{source}/sellers.csv"
    _write_parts(sellers, path, "seller_id", [0, 1])
    old = set(storage.data_files(t.spark, path))
    _write_parts(sellers.limit(0).unionAll(sellers.filter(share("seller_id", 4, 2))), path, "seller_id", [2])
    (stale,) = set(storage.data_files(t.spark, path)) - old
    _write_parts(t.raw["customers"], f"{source}/customers.csv", "customer_id", [0, 1, 2, 3])
    ingest(t.spark, source, lake)
    storage.delete(t.spark, stale)
    _write_parts(sellers, path, "seller_id", [2, 3])
    return ingest(t.spark, source, lake).filter(F.col("table").isin(*FILE_TABLES))


@case(
    "op_ingest_skipped",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", '{'loaded' if name in FILE_TABLES else 'skipped'}' AS status,
                   {'count(*)' if name in FILE_TABLES else 'CAST(NULL AS BIGINT)'} AS "rows"
            FROM {cte if name in FILE_TABLES else '(SELECT 1)'}"""
        for name, cte in RAW_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """Sources of two tables only: the others are skipped."""
    root = folder(t, "skipped")
    for table in FILE_TABLES:
        t.raw[table].write.csv(f"{root}/in/{table}.csv", header=True, escape='"')
    return ingest(t.spark, f"{root}/in", f"{root}/lake").select("table", "status", "rows")


# --- keys, layout, months -------------------------------------------------------------------

REPEATED = {"customers": ("customer_id", 2), "sellers": ("seller_id", 3), "products": ("product_id", 1), "category_translation": ("product_category_name", 1)}


@case(
    "op_key_check",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", {f'count(DISTINCT {key})' if n > 1 else '0 * count(*)'} AS keys,
                   {n - 1} * count(*) AS "rows"
            FROM {RAW_NAMES[name]}"""
        for name, (key, n) in REPEATED.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """What a refresh finds when customers come twice and sellers three times."""
    raw, root = dict(t.raw), folder(t, "repeats")
    for name, (_, n) in REPEATED.items():
        copies = F.explode(F.sequence(F.lit(1), F.lit(n)))
        raw[name] = raw[name].select("*", copies.alias("copy")).drop("copy")
    refresh(t.spark, raw, root, facts=False)
    found = manifest(t.spark, root, current(t.spark, root))["repeats"]
    rows = [(name, n["keys"], n["rows"]) for name, n in found.items()]
    return t.spark.createDataFrame(rows, "table string, keys bigint, rows bigint")


@case(
    "op_sort_layout",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"table\", count(*) AS \"rows\", 0 AS overlapping FROM {cte}"
        for name, cte in CURATED_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    """Rows of each published table, and its files whose key ranges overlap: none."""
    found = None
    for table in TABLES:
        files = layout(published(t).table(table), SORT_KEYS[table])
        one = files.agg(F.sum("rows").alias("rows"), F.count_if("overlaps").alias("overlapping"))
        one = one.select(F.lit(table).alias("table"), "rows", "overlapping")
        found = one if found is None else found.unionAll(one)
    return found


@case(
    "op_month_pruned",
    """SELECT order_year, count(*) AS orders, CAST(sum(is_late) AS BIGINT) AS late_orders FROM c_orders
       WHERE substr(order_month, 6, 2) IN ('10', '11', '12') GROUP BY order_year""",
)
def _(t: Inputs) -> DataFrame:
    """Orders of every last quarter: folders of other months are not read."""
    last = months(t.spark, "1990-01", "2010-12").filter("quarter = 4")
    orders = published(t).in_months("orders", last, "order_month", "order_year", "is_late")
    late = F.sum("is_late").cast("bigint").alias("late_orders")
    return orders.groupBy("order_year").agg(F.count(F.lit(1)).alias("orders"), late)


@case(
    "op_refresh_report",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"table\", count(*) AS \"rows\" FROM {cte}" for name, cte in CURATED_NAMES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    return refresh(t.spark, t.raw, folder(t, "counts"), facts=False)


# --- reports with other parameters ----------------------------------------------------------


@case(
    "report_delay_vs_score_not_imputed",
    DELAY_VS_SCORE.replace("FROM c_reviews", "FROM flagged"),
)
def _(t: Inputs) -> DataFrame:
    """Missing durations stay missing, so averages skip them."""
    return reports.delay_vs_score(Warehouse.computed(t.raw, Params(impute_missing=False)))


@case(
    "report_late_rate_by_state_weighted_gap",
    LATE_BY_STATE.replace(
        "WITH per_state AS (",
        "WITH whole AS (SELECT sum(tot)::DOUBLE / (count(tot)::DOUBLE * 10.0::DOUBLE) AS mean"
        " FROM oi WHERE order_status = 'delivered'), per_state AS (",
    ).replace("avg(avg_tot) OVER ()", "(SELECT mean FROM whole)"),
)
def _(t: Inputs) -> DataFrame:
    """The gap to the average row instead of the average state."""
    return reports.late_rate_by_state(published(t), Params(weighted_gap=True))


@case(
    "report_one_star_causes_whole_words",
    ONE_STAR_CAUSES.replace(
        "FROM c_reviews",
        r"""FROM (SELECT review_score, is_late, is_delivery_complaint,
                         CASE WHEN regexp_matches(lower(review_comment_message),
                             '\b(atraso|atrasado|demorou|demora|tardou|tarde|delayed|late|slow|'
                             || 'waiting|waited|never arrived)\b') THEN 1 ELSE 0 END
                             AS comment_has_delay_keyword
                  FROM c_reviews) AS words""",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.one_star_causes(Warehouse.computed(t.raw, Params(whole_words=True)))


# --- reports by name ------------------------------------------------------------------------


def _by_name(t: Inputs, query: str) -> DataFrame:
    register_functions(t.spark, published(t), "market_")
    return t.spark.sql(query)


@case(
    "op_report_by_name_scores",
    REPORT_SQL["score_distribution"].replace(
        "FROM c_reviews", "FROM c_reviews WHERE order_month >= '1994-01' AND order_month <= '1995-06'"
    ),
)
def _(t: Inputs) -> DataFrame:
    return _by_name(t, "SELECT * FROM market_score_distribution('1994-01', last_month => '1995-06')")


@case("op_report_by_name_sellers", REPORT_SQL["problem_sellers"].replace(">= 50)", ">= 5)").replace("LIMIT 50", "LIMIT 7"))
def _(t: Inputs) -> DataFrame:
    return _by_name(
        t,
        """SELECT * FROM market_problem_sellers(min_orders => 5)
           ORDER BY contribution_national_late_pct DESC, seller_id, seller_state, seller_city LIMIT 7""",
    )


@case(
    "op_report_by_name_priority",
    REPORT_SQL["intervention_priority"].replace(">= 50", ">= 5").replace("> 20 AND", "> 1 AND").replace("> 2\n", "> 0\n"),
)
def _(t: Inputs) -> DataFrame:
    return _by_name(
        t,
        """SELECT * FROM market_intervention_priority(min_orders => 5, slow_days => 0, late_pct => 1)
           ORDER BY freight_paid_on_late_orders DESC, seller_id, seller_state LIMIT 20""",
    )
