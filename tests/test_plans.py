"""Physical plans: pruning, pushdown, reuse, and behaviour under skew."""

from __future__ import annotations

import ast
import re
from pathlib import Path

import pytest
from helpers import SF, final_plan, planned
from pyspark.sql import functions as F

from parcelwatch.operators.enrich import enrich_items
from parcelwatch.operators.fanout import STAGES, delivery_facts, group_measures, order_groups
from parcelwatch.params import Params
from parcelwatch.plans import reports
from parcelwatch.plans.curated import Warehouse, refresh

ROOT = Path(__file__).resolve().parent.parent
FACT_REPORTS = (
    "late_rate_by_state",
    "stages_by_state",
    "route_comparison",
    "problem_sellers",
    "freight_loss",
    "freight_loss_bands",
    "sla_distribution",
    "intervention_priority",
)


@pytest.fixture(scope="module")
def wh(spark, inputs, tmp_path_factory):
    """Published tables without the shared facts: reports make the joins themselves."""
    root = str(tmp_path_factory.mktemp("warehouse"))
    refresh(spark, inputs.raw, root, facts=False)
    return Warehouse.published(spark, root)


@pytest.fixture
def large(conf):
    """Plans as they are when no side is small enough to broadcast."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )


def scanned(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


# The corpus operators are an optional subpackage with rules of its own (see its tests).
LIBRARY = [p for p in (ROOT / "parcelwatch").rglob("*.py") if "llm" not in p.parts]


def test_library_never_collects():
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "cache", "persist"}
    banned |= {"crossJoin", "udf", "pandas_udf", "applyInPandas", "mapInPandas", "rdd", "take"}
    for path in LIBRARY:
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in banned, f"{path}: {node.attr}"


def test_library_gives_no_broadcast_hint():
    for path in LIBRARY:
        assert "broadcast(" not in path.read_text(), path


def test_scan_reads_two_columns_and_pushes_the_filter(spark):
    from checks.cases import run_case

    plan = planned(run_case("op_scan_prune")(spark, SF))
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "EqualTo(o_orderstatus,F)" in plan
    (schema,) = {s for s in scanned(plan)}
    assert "o_custkey" not in schema


def test_reports_read_only_their_columns(wh):
    plan = planned(reports.late_rate_monthly(wh))
    (schema,) = set(scanned(plan))
    names = {part.split(":")[0] for part in schema.split(",")}
    assert names == {"order_id", "order_status", "is_late"}  # the month is a folder
    assert "EqualTo(order_status,delivered)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*order_month", plan)


@pytest.mark.parametrize("name", FACT_REPORTS)
def test_reports_join_facts_without_nested_loops_or_expand(wh, large, name):
    plan = final_plan(reports.REPORTS[name](wh))
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert "Expand" not in plan  # distinct orders are plain counts
    assert "Window" not in plan  # totals are no window over one partition


@pytest.mark.parametrize("name", FACT_REPORTS)
def test_items_are_combined_before_their_first_shuffle(wh, large, name):
    lines = final_plan(reports.REPORTS[name](wh)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "/order_items" in line]
    assert scans
    for i in scans:
        above = next(x for x in reversed(lines[:i]) if "Exchange" in x or "partial_" in x)
        assert "partial_" in above


@pytest.mark.parametrize("name", ["problem_sellers", "late_rate_by_state", "sla_distribution"])
def test_totals_reuse_the_shuffle_of_the_groups(wh, large, name):
    """The facts are scanned once although the totals need the groups as well."""
    plan = final_plan(reports.REPORTS[name](wh))
    assert "ReusedExchange" in plan
    assert len(re.findall(r"FileScan parquet [^\n]*/order_items", plan)) == 1


@pytest.mark.parametrize("name", FACT_REPORTS)
def test_only_totals_go_to_one_partition(wh, large, name):
    """A single partition holds one partial total per task, never the groups."""
    lines = final_plan(reports.REPORTS[name](wh)).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[]" in lines[i + 1]


def test_top_lists_sort_only_the_head(wh, large):
    assert "TakeOrderedAndProject" in final_plan(reports.problem_sellers(wh))


def test_small_lookups_are_broadcast_and_large_ones_shuffled(inputs, conf):
    names = ("order_items", "orders", "customers", "sellers", "products", "category_translation")
    items = enrich_items(*[inputs.raw[n] for n in names])
    assert "BroadcastHashJoin" in final_plan(items)
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    plan = final_plan(enrich_items(*[inputs.raw[n] for n in names]))
    assert "BroadcastHashJoin" not in plan
    assert "SortMergeJoin" in plan


def test_products_are_joined_before_the_columns_of_orders_are_there(inputs, large):
    """Large products are shuffled with the items alone."""
    names = ("order_items", "orders", "customers", "sellers", "products", "category_translation")
    plan = final_plan(enrich_items(*[inputs.raw[n] for n in names]))
    joins = re.findall(r"SortMergeJoin\(?.*?\[(\w+)#", plan)  # outer ones first
    assert joins.index("order_id") < joins.index("product_id")


def test_items_are_not_shuffled_by_the_names_of_categories(inputs, large):
    """Products take their labels before items see them."""
    names = ("order_items", "orders", "customers", "sellers", "products", "category_translation")
    plan = final_plan(enrich_items(*[inputs.raw[n] for n in names]))
    joins = re.findall(r"SortMergeJoin\(?.*?\[(\w+)#", plan)  # outer ones first
    assert joins.index("product_id") < joins.index("product_category_name")


# --- skew ---


@pytest.fixture
def skewed(large, conf):
    conf(
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    )


N = 120_000


def hot_market(spark):
    """A third of the items belong to one seller, another third to one order."""
    items = spark.range(0, N, numPartitions=8).selectExpr(
        "CASE WHEN id % 3 = 1 THEN 'hot order' ELSE 'o' || id % 40000 END AS order_id",
        "CAST(id % 5 AS INT) AS order_item_id",
        "'p' || id % 1000 AS product_id",
        "CASE WHEN id % 3 = 0 THEN 'hot seller' ELSE 's' || id % 3000 END AS seller_id",
        "'2018-01-01' AS shipping_limit_date",
        "(id % 900) / 10.0D AS price",
        "(id % 70) / 10.0D AS freight_value",
    )
    orders = spark.range(0, 40001).selectExpr(
        "CASE WHEN id = 40000 THEN 'hot order' ELSE 'o' || id END AS order_id",
        "'c' || id % 5000 AS customer_id",
        "'delivered' AS order_status",
        "'2018-01-01 00:00:00' AS order_purchase_timestamp",
    )
    customers = spark.range(0, 5000).selectExpr(
        "'c' || id AS customer_id", "'S' || id % 20 AS customer_state", "'x' AS customer_city"
    )
    sellers = spark.range(0, 3001).selectExpr(
        "CASE WHEN id = 3000 THEN 'hot seller' ELSE 's' || id END AS seller_id",
        "'S' || id % 20 AS seller_state",
        "'y' AS seller_city",
    )
    products = spark.range(0, 1000).selectExpr(
        "'p' || id AS product_id", "'k' || id % 9 AS product_category_name"
    )
    translation = spark.range(0, 5).selectExpr(
        "'k' || id AS product_category_name", "'e' || id AS product_category_name_english"
    )
    return items, orders, customers, sellers, products, translation


def test_hot_seller_and_order_are_split_over_tasks(spark, skewed):
    columns = ("order_id", "seller_id", "seller_state", "customer_state")
    df = enrich_items(*hot_market(spark), columns=columns)
    plan = final_plan(df)
    assert plan.count("skew=true") == 2  # the join on the order and the one on the seller
    assert df.count() == N
    assert df.filter("seller_id = 'hot seller' AND seller_state = 'S0'").count() == N // 3
    assert df.filter("order_id = 'hot order'").count() == N // 3


def test_hot_order_and_seller_travel_combined(spark, skewed):
    items, orders, *_ = hot_market(spark)
    days = [F.lit(1.0).alias(stage) for stage in STAGES]
    orders = orders.select("order_id", "order_status", F.lit(1).alias("is_late"), *days)
    reviews = spark.createDataFrame([], "order_id string, review_score int")
    groups = order_groups(delivery_facts(items, orders, reviews, ["seller_id"]), ["seller_id"])
    # no more rows per order than it has sellers, however many items it has
    hot = groups.filter("order_id = 'hot order'")
    assert hot.count() == 1000
    sums = group_measures(groups, ["seller_id"], ["orders", "rows"])
    assert sums.agg(F.sum("rows")).first()[0] == N
    seller = sums.filter("seller_id = 'hot seller'").first()
    assert (seller["orders"], seller["rows"]) == (40000, N // 3)


def test_settings_are_applied_to_a_given_session(spark):
    from parcelwatch.session import SETTINGS, configure

    configure(spark)
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value


def test_shared_folder_is_the_one_the_session_names(spark):
    from parcelwatch.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
