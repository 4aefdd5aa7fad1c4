"""Reports: weighted joins against the literal join, invariants and edge cases."""

from __future__ import annotations

import pytest
from helpers import column, item, order, raw_tables, review, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwatch.operators.fanout import delivery_facts, group_measures, order_groups
from parcelwatch.params import Params
from parcelwatch.plans import reports
from parcelwatch.plans.curated import Warehouse

P = Params()
ALL = Params(min_orders=1, min_orders_sla=1, slow_days=-1, late_pct=-1)


@pytest.fixture(scope="module")
def wh(inputs):
    """The shared test market, computed once."""
    tables = {
        t: inputs.wh.table(t).cache() for t in ("orders", "order_items", "order_reviews")
    }
    yield Warehouse(lambda name, cols: tables[name].select(*cols) if cols else tables[name])
    for df in tables.values():
        df.unpersist()


def total(df, name):
    return df.agg(F.sum(name)).first()[0]


# --- the weighted join ---

MEASURES = (
    "orders",
    "late_orders",
    "rows",
    "late_rows",
    "seller_processing_days_tenths",
    "seller_processing_days_n",
    "price_cents",
    "freight_cents",
    "late_freight_cents",
    "score_sum",
    "scores",
    "one_star",
)


def literal(orders, items, reviews):
    """Per seller, by looping over the joined rows."""
    groups: dict[str, dict] = {}
    for it in items:
        for od in (od for od in orders if od[0] == it[0]):
            for score in [r[1] for r in reviews if r[0] == od[0]] or ["none"]:
                g = groups.setdefault(it[1], {m: 0 for m in MEASURES} | {"seen": set()})
                late, days = od[1], od[2]
                g["seen"].add((od[0], late))
                g["rows"] += 1
                g["late_rows"] += late
                g["seller_processing_days_tenths"] += round((days or 0) * 10)
                g["seller_processing_days_n"] += days is not None
                g["price_cents"] += it[2]
                g["freight_cents"] += it[3]
                g["late_freight_cents"] += it[3] * late
                if score not in ("none", None):
                    g["score_sum"] += score
                    g["scores"] += 1
                    g["one_star"] += score == 1
    for g in groups.values():
        g["orders"] = len({o for o, _ in g["seen"]})
        g["late_orders"] = len({o for o, late in g["seen"] if late})
    return {s: tuple(g[m] for m in MEASURES) for s, g in groups.items()}


ids = st.sampled_from("abcd")
order_rows = st.lists(
    st.tuples(ids, st.integers(0, 1), st.sampled_from([None, -1.5, 0.0, 2.3])), max_size=6
)
item_rows = st.lists(
    st.tuples(ids, st.sampled_from("xyz"), st.integers(0, 500), st.integers(0, 90)), max_size=8
)
review_rows = st.lists(st.tuples(ids, st.sampled_from([1, 2, 5, None])), max_size=6)


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(orders=order_rows, items=item_rows, reviews=review_rows)
def test_weighted_join_equals_the_literal_join(spark, orders, items, reviews):
    """Also for repeated order ids, missing scores and missing durations."""
    od = spark.createDataFrame(
        [(o, "delivered", late, d, 1.0, 1.0) for o, late, d in orders],
        "order_id string, order_status string, is_late int, seller_processing_days double, "
        "carrier_delivery_days double, total_delivery_days double",
    )
    money = [(o, s, p / 100, f / 100) for o, s, p, f in items]
    it = spark.createDataFrame(
        money, "order_id string, seller_id string, price double, freight_value double"
    )
    rv = spark.createDataFrame(reviews, "order_id string, review_score int")
    facts = delivery_facts(it, od, rv, ["seller_id"])
    sums = group_measures(order_groups(facts, ["seller_id"]), ["seller_id"], MEASURES)
    got = {r[0]: tuple(v or 0 for v in r[1:]) for r in sums.collect()}
    assert got == literal(orders, items, reviews)


def market(spark):
    """Order a: two items of s1, one of s2, two reviews, late. Order b: one item, no review."""
    return Warehouse.computed(
        raw_tables(
            spark,
            orders=[order("a", days=(0, 0, 4, 20, 10)), order("b", days=(0, 0, 2, 5, 10))],
            order_items=[item("a"), item("a", number=2), item("a", "s2"), item("b")],
            order_reviews=[review("a", 1), review("a", 2)],
        )
    )


def test_rows_are_weighted_as_published(spark):
    losses = reports.intervention_priority(market(spark), ALL)
    s1 = {r.seller_id: r for r in losses.collect()}["s1"]
    assert s1.total_orders == 2
    assert s1.late_orders == 4  # two items times two reviews
    assert s1.late_rate_pct == 80.0
    assert s1.avg_processing_days == 3.6  # (4 * 4.0 + 1 * 2.0) / 5
    assert s1.total_revenue == 50.0
    assert s1.freight_paid_on_late_orders == 8.0
    assert s1.avg_review_score == 1.5
    assert s1.total_bintang_1 == 2


def test_per_order_counts_each_order_once(spark):
    losses = reports.intervention_priority(market(spark), ALL, per_order=True)
    s1 = {r.seller_id: r for r in losses.collect()}["s1"]
    assert (s1.total_orders, s1.late_orders) == (2, 1)
    assert s1.late_rate_pct == 50.0
    assert s1.avg_processing_days == 3.0
    assert s1.total_revenue == 30.0
    assert s1.freight_paid_on_late_orders == 4.0
    assert s1.avg_review_score == 1.5
    assert s1.total_bintang_1 == 1


def test_groups_without_reviews_have_no_score(spark):
    wh = Warehouse.computed(
        raw_tables(spark, orders=[order("a")], order_items=[item("a")], order_reviews=[])
    )
    (row,) = reports.freight_loss(wh, ALL).collect()
    assert row.avg_review_score is None
    assert row.total_1star == 0


def test_nothing_late_gives_no_share_instead_of_an_error(spark):
    wh = Warehouse.computed(
        raw_tables(spark, orders=[order("a")], order_items=[item("a", freight=0.0)])
    )
    (state,) = reports.late_rate_by_state(wh).collect()
    assert state.contribution_to_national_late_pct is None
    assert state.late_rate_pct == 0.0
    (seller,) = reports.problem_sellers(wh, ALL).collect()
    assert seller.contribution_national_late_pct is None
    (loss,) = reports.freight_loss(wh, ALL).collect()
    assert loss.pct_freight_wasted is None


def test_all_reports_accept_empty_tables(spark):
    wh = Warehouse.computed(raw_tables(spark))
    for name, report in reports.REPORTS.items():
        assert report(wh).count() == (2 if name == "stage_statistics" else 0), name


def test_stage_without_data_keeps_its_row(spark):
    wh = Warehouse.computed(raw_tables(spark, orders=[order("a", days=(0, 0, 2, None, 9))]))
    stages = {r.komponen: r for r in reports.stage_statistics(wh).collect()}
    assert stages["Seller Processing Time"].median_hari == 2.0
    assert stages["Carrier Transit Time"].median_hari is None
    assert stages["Carrier Transit Time"].status_p90 == "Normal"


def test_quantiles_are_interpolated(spark):
    days = (1, 2, 3, 10)
    orders = [order(str(d), days=(0, 0, d, d + 4, 20)) for d in days]
    wh = Warehouse.computed(raw_tables(spark, orders=orders))
    row = {r.komponen: r for r in reports.stage_statistics(wh).collect()}["Seller Processing Time"]
    assert (row.median_hari, row.p90_hari, row.maksimum_hari) == (2.5, 7.9, 10.0)
    assert row.rata_rata_hari == 4.0


def test_imputed_zeros_enter_the_averages(spark):
    raw = raw_tables(
        spark, orders=[order("a", days=(0, 0, 4, 8, 9)), order("b", days=(0, 0, None, 8, 9))]
    )
    name = "avg_seller_processing_days"
    published = reports.stage_contribution_monthly(Warehouse.computed(raw))
    assert column(published, name) == [2.0]
    params = Params(impute_missing=False)
    ignored = reports.stage_contribution_monthly(Warehouse.computed(raw, params), params)
    assert column(ignored, name) == [4.0]


def test_gap_to_mean_of_groups_or_of_rows(spark):
    raw = raw_tables(
        spark,
        orders=[order(str(n), days=(0, 0, 1, 4, 9), customer="c1") for n in range(3)]
        + [order("x", days=(0, 0, 1, 8, 9), customer="c2")],
        order_items=[item(o) for o in ("0", "1", "2", "x")],
        customers=[
            {"customer_id": "c1", "customer_state": "SP"},
            {"customer_id": "c2", "customer_state": "RJ"},
        ],
    )

    def gaps(params):
        df = reports.late_rate_by_state(Warehouse.computed(raw), params)
        return {r.customer_state: r.diff_vs_national_avg_days for r in df.collect()}

    assert gaps(P) == {"SP": -2.0, "RJ": 2.0}
    assert gaps(Params(weighted_gap=True)) == {"SP": -1.0, "RJ": 3.0}


def test_repeated_order_ids_are_one_distinct_order(spark):
    late = order("a", days=(0, 0, 1, 20, 10))
    wh = Warehouse.computed(raw_tables(spark, orders=[late, late, order("b")]))
    (month,) = reports.late_rate_monthly(wh).collect()
    assert (month.total_orders, month.late_orders, month.late_rate_pct) == (3, 2, 50.0)


# --- qualification of sellers: distinct rate against rounded row rate ---


def test_the_two_loss_lists_qualify_sellers_differently(spark):
    # one late order with many items: 1 of 6 orders, but most rows are late
    orders = [order("late", days=(0, 0, 4, 20, 10))]
    orders += [order(str(n), days=(0, 0, 4, 8, 10)) for n in range(5)]
    items = [item("late", number=n) for n in range(9)] + [item(str(n)) for n in range(5)]
    wh = Warehouse.computed(raw_tables(spark, orders=orders, order_items=items))
    params = Params(min_orders=1)
    assert reports.freight_loss(wh, params).count() == 0  # 16.7 % of orders
    assert reports.intervention_priority(wh, params).count() == 1  # 64.3 % of rows


# --- invariants on the shared market ---


@pytest.mark.parametrize(
    ("name", "share"),
    [
        ("score_distribution", "percentage"),
        ("late_rate_by_state", "contribution_to_national_late_pct"),
        ("sla_distribution", "order_share_pct"),
    ],
)
def test_shares_sum_to_hundred(wh, name, share):
    df = reports.REPORTS[name](wh)
    assert total(df, share) == pytest.approx(100.0, abs=0.1 * df.count())


def test_seller_shares_sum_to_hundred_among_qualifying_sellers(wh):
    everybody = Params(top_contributors=10**6)
    df = reports.problem_sellers(wh, everybody)
    assert df.count() > 5
    assert total(df, "contribution_national_late_pct") == pytest.approx(100.0, abs=0.1)


def test_bands_hold_every_qualifying_seller(wh):
    items = wh.table("order_items", "order_id", "seller_id")
    orders = wh.table("orders").filter("order_status = 'delivered'")
    qualifying = (
        items.join(orders, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count_distinct("order_id").alias("n"), F.avg("seller_processing_days").alias("d")
        )
        .filter("n >= 50 AND d > 2")
        .count()
    )
    assert total(reports.freight_loss_bands(wh), "jumlah_seller") == qualifying


def test_states_and_routes_hold_the_delivered_orders(wh):
    delivered = (
        wh.table("orders")
        .filter("order_status = 'delivered'")
        .join(wh.table("order_items", "order_id").distinct(), "order_id")
        .count()
    )
    # an order has one customer, so one state
    assert total(reports.stages_by_state(wh), "total_orders") == delivered
    assert total(reports.route_comparison(wh), "total_orders") >= delivered


def test_per_order_keeps_distinct_counts(wh):
    for name in reports.PER_ORDER:
        report = reports.REPORTS[name]
        key = report(wh).columns[0]
        column_name = next(c for c in report(wh).columns if c.startswith("total_orders"))
        if name == "sla_distribution":  # bands shift, the orders in them do not get lost
            published, corrected = report(wh, ALL), report(wh, ALL, per_order=True)
            assert total(published, column_name) == total(corrected, column_name)
            continue
        wide = Params(top_losses=10**6, min_orders=1, slow_days=-1, late_pct=-1)
        published = {r[key]: r[column_name] for r in report(wh, wide).collect()}
        corrected = {r[key]: r[column_name] for r in report(wh, wide, per_order=True).collect()}
        assert published == corrected


def test_lists_are_sorted_and_cut(wh):
    few = Params(top_contributors=3)
    shares = column(reports.problem_sellers(wh, few), "contribution_national_late_pct")
    assert len(shares) == 3
    assert shares == sorted(shares, reverse=True)


def test_sla_bands_come_in_their_own_order(wh):
    names = column(reports.sla_distribution(wh, ALL), "sla_category")
    ranks = ["Fast (≤1 hari)", "Normal (1-3 hari)", "Slow (3-7 hari)", "Critical (>7 hari)"]
    assert names == [n for n in ranks if n in names]
    assert len(names) >= 3


def test_results_do_not_depend_on_partitioning(wh, conf):
    names = ("problem_sellers", "sla_distribution", "stages_by_state")
    first = [rows(reports.REPORTS[n](wh)) for n in names]
    conf(spark__sql__shuffle__partitions="3")
    mixed = Warehouse(lambda t, c: wh.table(t, *(c or ())).repartition(7))
    assert [rows(reports.REPORTS[n](mixed)) for n in names] == first
