"""Published versions: layout, grains, differences between versions, loading by file."""

from __future__ import annotations

import re
import time

import pytest
from helpers import final_plan, item, order, planned, raw_tables, review, rows
from pyspark.sql import functions as F

from checks.cases import FAN_SUMS
from parcelwatch.operators import enrich, grains
from parcelwatch.operators.distinct import count_orders, number_orders, order_bitmaps
from parcelwatch.operators.fanout import ITEM_KEYS
from parcelwatch.operators.shares import Totals
from parcelwatch.params import Params
from parcelwatch.plans import curated, delta, reports
from parcelwatch.plans.calendar import months
from parcelwatch.plans.curated import Warehouse, curate, lake_tables, manifest, refresh, versions_read
from parcelwatch.plans.ingest import ingest, load_files
from parcelwatch.schemas import TABLES
from parcelwatch.session import DROP_SHUFFLES
from parcelwatch.sources import lake as lakes
from parcelwatch.sources import storage
from parcelwatch.sources.buckets import forget, read_bucketed, write_bucketed
from parcelwatch.sources.tables import current, expire, layout, read_files, write_files, write_table


@pytest.fixture(scope="module")
def root(spark, inputs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("versions"))
    refresh(spark, inputs.raw, where, summaries=True)
    return where


@pytest.fixture(scope="module")
def wh(spark, root):
    return Warehouse.published(spark, root)


@pytest.fixture
def large(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


# --- facts dealt by order, and grains -------------------------------------------------------


def shuffled_by(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("grain", grains.GRAINS)
def test_no_report_shuffles_facts_by_order(wh, large, grain):
    found = wh.without_grains().measures(grain, list(FAN_SUMS), Params())
    plan = final_plan(found)
    assert "Bucketed: true" in plan
    assert not [keys for keys in shuffled_by(plan) if "order_id" in keys]


def test_all_grains_come_from_one_scan_and_one_small_shuffle(wh, large):
    plan = final_plan(grains.all_grains(wh.facts(), Params()))
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert not [keys for keys in shuffled_by(plan) if "order_id" in keys]
    assert len(shuffled_by(plan)) == 1


def test_reports_read_grains_and_nothing_else(wh):
    for name in ("late_rate_by_state", "stages_by_state", "route_comparison", "problem_sellers", "freight_loss", "freight_loss_bands", "sla_distribution", "intervention_priority"):
        scans = re.findall(r"Location: [^\[]*\[([^\]]*)\]", planned(reports.REPORTS[name](wh)))
        assert {s.rpartition("/")[2] for s in scans} == {"delivery_grains"}, name


@pytest.mark.parametrize("params", [Params(hub_state="RJ"), Params(moving=("delivered",)), Params(min_orders=3)])
def test_other_parameters_are_answered_from_the_facts_if_need_be(wh, params):
    for name in ("route_comparison", "problem_sellers"):
        assert rows(reports.REPORTS[name](wh, params)) == rows(reports.REPORTS[name](wh.without_facts(), params))


@pytest.mark.parametrize("counting", grains.COUNTINGS)
def test_published_measures_equal_the_computed_ones(wh, counting):
    names = ["orders", "late_orders", *grains.counted(**grains.COUNTINGS[counting])]
    for grain in grains.GRAINS:
        read = wh.measures(grain, names, Params(), counting)
        plain = wh.without_facts().measures(grain, names, Params(), counting)
        assert sorted(map(str, rows(read))) == sorted(map(str, rows(plain))), grain


def test_an_order_with_two_copies_and_two_sellers_is_counted_once(spark, tmp_path):
    """Copies of an order with other statuses, and two sellers of one state and route."""
    raw = raw_tables(
        spark,
        orders=[order("a", days=(0, 0, 1, 20, 10)), order("a"), order("a", "shipped"), order("b")],
        order_items=[item("a", "s1"), item("a", "s2", number=2), item("a", "s1", number=3), item("b", "s2")],
        order_reviews=[review("a", 1), review("a", 5), review("b", None)],
        customers=[{"customer_id": "c1", "customer_state": "RJ"}],
        sellers=[{"seller_id": s, "seller_state": "SP", "seller_city": "x"} for s in ("s1", "s2")],
    )
    refresh(spark, raw, str(tmp_path))
    wh = Warehouse.published(spark, str(tmp_path))
    for counting in grains.COUNTINGS:
        names = ["orders", "late_orders", *grains.counted(**grains.COUNTINGS[counting])]
        for grain in grains.GRAINS:
            read = wh.measures(grain, names, Params(), counting)
            assert sorted(map(str, rows(read))) == sorted(map(str, rows(wh.without_facts().measures(grain, names, Params(), counting))))
    assert rows(wh.measures("route", ["orders", "late_orders"], Params())) == [("SP → Luar SP", 2, 1)]


def test_buckets_survive_a_new_name_and_hold_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/it's"
    df = spark.range(1000).selectExpr("CAST(id % 300 AS STRING) AS order_id", "id AS n")
    write_bucketed(df, path, "order_id", 5)
    forget(spark, path)
    again = read_bucketed(spark, path, "order_id string, n bigint", "order_id", 5)
    assert again.count() == 1000
    counts = again.groupBy("order_id").count()
    assert "Exchange" not in planned(counts) and counts.count() == 300
    forget(spark, path)
    assert storage.exists(spark, path)


# --- merged counts, exact means -------------------------------------------------------------


def test_bitmaps_count_orders_that_groups_share(spark):
    pairs = spark.range(70_000).selectExpr("'o' || id % 50000 AS order_id", "id % 7 AS g", "id % 3 AS h", "IF(id % 50000 % 11 = 0, 1, 0) AS late")
    numbers = number_orders(pairs, "order_id", ("g",))
    rows_ = {r.order_id: r.number for r in numbers.collect()}
    assert len(set(rows_.values())) == 50_000
    known = spark.createDataFrame(list(rows_.items()), "order_id string, number long")
    bitmaps = order_bitmaps(pairs.join(known, "order_id"), ("g", "h"))
    for keys in (("g",), ("h",), ("g", "h"), ()):
        late = F.count_distinct(F.when(F.col("late") == 1, F.col("order_id")))
        want = pairs.groupBy(*keys).agg(F.count_distinct("order_id"), late)
        assert sorted(map(tuple, count_orders(bitmaps, keys).collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_share_buckets(wh):
    """A group of n orders has few more rows than n / 32,768."""
    groups = wh.bitmaps().groupBy("order_month", "seller_id").agg(F.count_distinct("bucket").alias("n"))
    assert groups.agg(F.avg("n")).first()[0] < 2


def test_bitmaps_of_small_groups_are_small(spark, wh):
    """A group of one order costs a few bytes to gather, not two buffers of 4 KiB, and no sort."""
    pairs = spark.range(3000).selectExpr("'o' || id AS order_id", "id AS g", "id AS number", "0 AS late")
    bitmaps = order_bitmaps(pairs, ("g",))
    assert dict(bitmaps.dtypes)["orders"] == dict(bitmaps.dtypes)["late_orders"] == "bigint"
    assert "SortAggregate" not in planned(bitmaps) and "SortAggregate" not in planned(count_orders(bitmaps, ("g",)))
    assert rows(count_orders(bitmaps)) == [(3000, 0)]
    assert "SortAggregate" not in planned(count_orders(wh.bitmaps(), ("order_month",)))


def test_copies_of_facts_are_made_without_arrays_of_keys(wh):
    copied = planned(grains.all_grains(wh.facts(), Params()))
    assert "Generate explode" in copied and "lambdafunction" not in copied and "named_struct" not in copied


def test_means_do_not_depend_on_the_order_of_rows(spark, wh):
    values = spark.range(5000).selectExpr("id", "sin(id) / 3 AS x")
    found = set()
    for parts in (1, 7, 64):
        some = values.repartition(parts, "x")
        totals = Totals(some, ("id",), {"x": F.col("x")})
        found.add(spark.range(1).select(totals.mean("x")).first()[0])
    assert len(found) == 1
    for name in ("late_rate_by_state", "problem_sellers"):
        seen = set()
        for parts in (1, 7, 64):
            load = lambda table, columns, parts=parts: wh.table(table, *(columns or ())).repartition(parts)
            seen.add(str(rows(reports.REPORTS[name](Warehouse(load)))))
        assert len(seen) == 1


def test_sketches_of_some_months_read_nothing_else(wh):
    some = reports.merged_stage_quantiles(wh, months=("1995-01", "1995-12"))
    whole = reports.merged_stage_quantiles(wh)
    assert some.agg(F.sum("n")).first()[0] < whole.agg(F.sum("n")).first()[0]
    assert "/orders" not in planned(some) and "stage_sketches" in planned(some)
    with pytest.raises(LookupError, match="summaries"):
        wh.without_facts().bitmaps()


# --- layout ---------------------------------------------------------------------------------


def test_files_of_a_table_do_not_overlap(spark, tmp_path, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, 0, id * 7919 % 1000) AS a", "id * 104729 % 20011 AS b")
    write_files(df, f"{tmp_path}/sorted", ("a", "b"))
    found = layout(read_files(spark, f"{tmp_path}/sorted"), ("a", "b")).collect()
    assert len(found) > 4 and not any(r.overlaps for r in found) and sum(r["rows"] for r in found) == 20_000
    df.repartition(6).write.parquet(f"{tmp_path}/mixed")
    mixed = layout(read_files(spark, f"{tmp_path}/mixed"), ("a", "b")).collect()
    assert sum(r.overlaps for r in mixed) == 5


def scanned_rows(spark, df):
    """Rows that the scans of a query gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, total = plan.toString(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert "FileScan parquet" in text
    return total


def test_a_lookup_by_another_column_skips_row_groups(spark, tmp_path, conf):
    """Values of every file span the whole range, so only the Bloom filters can rule files out."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(40_000).selectExpr("id AS a", "md5(CAST(id AS STRING)) AS k")
    write_files(df, f"{tmp_path}/plain", ("a",))
    write_files(df, f"{tmp_path}/bloom", ("a",), bloom=("k",))
    key = df.filter("a = 12345").first()["k"]
    read = {}
    for name in ("plain", "bloom"):
        found = read_files(spark, f"{tmp_path}/{name}").filter(F.col("k") == key)
        read[name] = scanned_rows(spark, found)
        assert found.first()["a"] == 12345
    assert read["plain"] == 40_000 and read["bloom"] <= 10_000


def test_published_lookups_have_filters(wh):
    files = wh.table("order_items").inputFiles()
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0)
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert {"order_id", "customer_id"} <= set(by_name)


def test_months_are_folders_and_a_join_prunes_them(spark, wh, root):
    version = current(spark, root)
    assert [n for n in storage.names(spark, f"{root}/{version}/orders") if n.startswith("order_month=")]
    last = months(spark, "1990-01", "2010-12").filter("quarter = 4")
    some = wh.in_months("orders", last, "order_month", "order_id")
    assert "dynamicpruningexpression" in planned(some)
    whole = wh.table("orders", "order_month", "order_id")
    want = whole.filter(F.substring("order_month", 6, 2).isin("10", "11", "12"))
    assert some.count() == want.count() > 0
    assert scanned_rows(spark, some) == want.count() < whole.count()
    assert tuple(wh.table("order_reviews").columns) == tuple(wh.without_facts().table("order_reviews").columns)


def test_calendar(spark):
    assert rows(months(spark, "2017-12", "2018-02")) == [("2017-12", 2017, 4, 12), ("2018-01", 2018, 1, 1), ("2018-02", 2018, 1, 2)]


# --- repeated keys --------------------------------------------------------------------------


def test_repeated_lookup_keys_are_reported_or_refused(spark, tmp_path):
    raw = raw_tables(
        spark,
        orders=[order("a")],
        order_items=[item("a")],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}, {"seller_id": "s1", "seller_state": "RJ"}, {"seller_id": None}, {"seller_id": None}],
        customers=[{"customer_id": "c1", "customer_state": "SP"}],
    )
    where = str(tmp_path / "w")
    refresh(spark, raw, where)
    found = manifest(spark, where, current(spark, where))
    assert found["repeats"]["sellers"] == {"keys": 1, "rows": 1}
    assert found["repeats"]["customers"] == {"keys": 0, "rows": 0}
    assert found["rows"]["order_items"] == 2  # the item was multiplied
    before = current(spark, where)
    with pytest.raises(ValueError, match="sellers 1"):
        refresh(spark, raw, where, refuse_repeats=True)
    assert current(spark, where) == before


def test_repeated_keys_multiply_items_after_their_shuffles(spark, tmp_path, monkeypatch):
    """Six rows of an item travel as one; the rows are those of the plain joins."""
    raw = raw_tables(
        spark,
        orders=[order("a"), order("b", customer="nobody")],
        order_items=[item("a"), item("a", seller="gone", product="gone"), item("b"), item("b", seller=None)],
        sellers=[{"seller_id": "s1", "seller_state": s} for s in ("SP", "RJ", None)] + [{"seller_id": None}],
        customers=[{"customer_id": "c1", "customer_state": s} for s in ("SP", "SP")],
        products=[{"product_id": "p1", "product_category_name": n} for n in ("x", "y", None)],
        category_translation=[{"product_category_name": "x", "product_category_name_english": e} for e in ("X", "Z")],
    )
    want = sorted(map(repr, curate(raw, "order_items").collect()))
    assert len(want) == 4 * 2 * 3 + 2 + 4 * 3 + 4
    monkeypatch.setattr(enrich, "IN_ARRAY", 2)  # keys of more rows than an array holds
    sent = []
    plain = curated.write_files

    def watched(df, path, *args):
        if path.endswith("/order_items"):
            sent.append(df.count())
        plain(df, path, *args)

    monkeypatch.setattr(curated, "write_files", watched)
    refresh(spark, raw, str(tmp_path / "w"), facts=False)
    wh = Warehouse.published(spark, str(tmp_path / "w"))
    assert sorted(map(repr, wh.table("order_items").collect())) == want
    assert sent and sent[0] < len(want)
    assert manifest(spark, str(tmp_path / "w"), current(spark, str(tmp_path / "w")))["rows"]["order_items"] == len(want)


# --- refresh by difference ------------------------------------------------------------------


def contents(wh):
    out = {t: sorted(map(str, rows(wh.table(t)))) for t in TABLES}
    out["facts"] = sorted(map(str, rows(wh.facts(*ITEM_KEYS).select("order_id", *ITEM_KEYS, "n_items", "price", "n_copies", "n_reviews"))))
    for grain in grains.GRAINS:
        for counting in grains.COUNTINGS:
            names = ["orders", "late_orders", *grains.counted(**grains.COUNTINGS[counting])]
            out[grain, counting] = sorted(map(str, rows(wh.measures(grain, names, Params(), counting))))
    return out


MARKET = {
    "orders": [order(o) for o in "abcdef"] + [order(None)],
    "order_items": [item(o, s) for o, s in zip("abcdef", ["s1", "s2"] * 3, strict=True)] + [item(None), item("stray")],
    "order_reviews": [review("a", 1, review_id="r1"), review("b", 5, review_id="r2"), review(None, 2, review_id="r3")],
    "customers": [{"customer_id": "c1", "customer_state": "SP"}],
    "sellers": [{"seller_id": "s1", "seller_state": "SP", "seller_city": "x"}, {"seller_id": "s2", "seller_state": "RJ", "seller_city": "y"}],
    "products": [{"product_id": "p1", "product_category_name": "k"}],
    "category_translation": [{"product_category_name": "k", "product_category_name_english": "en"}],
    "mql": [{"mql_id": "m"}],
}

CHANGES = [
    {},
    {"orders": [*MARKET["orders"][1:], order("g"), order("b", "canceled")], "order_items": [*MARKET["order_items"], item("g", "s2", 5.0)]},
    {"order_items": MARKET["order_items"][2:] + [item("a", "s1", number=2)], "order_reviews": [review("a", 1, review_id="r1"), review("a", 1, review_id="r1"), review(None, 3, review_id="r3")]},
    {"customers": [{"customer_id": "c1", "customer_state": "RJ"}]},
    {"sellers": MARKET["sellers"][:1]},
    {"products": [{"product_id": "p1", "product_category_name": "other"}], "mql": [{"mql_id": "n"}, {"mql_id": "o"}]},
    {"category_translation": []},
]


@pytest.mark.parametrize("change", CHANGES, ids=lambda c: "+".join(c) or "none")
def test_a_refresh_by_difference_equals_a_full_one(spark, tmp_path, change):
    lake, root, full = (str(tmp_path / n) for n in ("lake", "by_difference", "full"))
    for table, df in raw_tables(spark, **MARKET).items():
        write_table(df, lake, table)
    refresh(spark, lake_tables(spark, lake), root)
    first = current(spark, root)
    for table, df in raw_tables(spark, **(MARKET | change)).items():
        if table in change:
            write_table(df, lake, table)
    report = delta.refresh_changed(spark, lake_tables(spark, lake), root)
    wanted = refresh(spark, lake_tables(spark, lake), full)
    assert rows(report) == rows(wanted)
    assert contents(Warehouse.published(spark, root)) == contents(Warehouse.published(spark, full))
    assert versions_read(spark, root) == [current(spark, root), first]
    # and back again: a version that reads one that reads another
    for table, df in raw_tables(spark, **MARKET).items():
        if table in change:
            write_table(df, lake, table)
    delta.refresh_changed(spark, lake_tables(spark, lake), root)
    assert contents(Warehouse.published(spark, root)) == contents(Warehouse._of_version(spark, root, first, manifest(spark, root, first)))
    assert expire(spark, root, keep=versions_read(spark, root), spare=0) == []


def test_facts_of_a_difference_come_from_its_written_tables(spark, tmp_path, monkeypatch):
    """The rows of changed orders are looked for in the lake once."""
    lake, root = str(tmp_path / "lake"), str(tmp_path / "wh")
    for table, df in raw_tables(spark, **MARKET).items():
        write_table(df, lake, table)
    refresh(spark, lake_tables(spark, lake), root)
    write_table(raw_tables(spark, orders=[*MARKET["orders"], order("g")])["orders"], lake, "orders")
    plans = []
    monkeypatch.setattr(delta, "write_facts", lambda df, *more: (plans.append(planned(df)), curated.write_facts(df, *more)))
    delta.refresh_changed(spark, lake_tables(spark, lake), root)
    (plan,) = plans
    assert f"{root}/{current(spark, root)}/order_items" in plan
    assert f"{lake}/" not in plan


def test_a_difference_writes_only_changed_orders(spark, tmp_path):
    lake, root = str(tmp_path / "lake"), str(tmp_path / "wh")
    for table, df in raw_tables(spark, **MARKET).items():
        write_table(df, lake, table)
    assert delta.refresh_changed(spark, lake_tables(spark, lake), root).count() == len(TABLES)  # nothing before: a full one
    write_table(raw_tables(spark, **MARKET)["orders"].unionAll(raw_tables(spark, orders=[order("g")])["orders"]), lake, "orders")
    delta.refresh_changed(spark, lake_tables(spark, lake), root)
    path = f"{root}/{current(spark, root)}"
    assert rows(spark.read.parquet(f"{path}/changed_orders")) == [("g",)]
    assert spark.read.parquet(f"{path}/orders").count() == 1
    assert "sellers" not in storage.names(spark, path)
    for t in TABLES:  # the lake gone, a difference cannot be told: a full refresh
        if t == "mql":
            storage.delete(spark, f"{lake}/{t}/{manifest(spark, root, current(spark, root))['lake'][t]}")
            write_table(raw_tables(spark, **MARKET)[t], lake, t)
    delta.refresh_changed(spark, lake_tables(spark, lake), root)
    assert versions_read(spark, root) == [current(spark, root)]


def test_orders_of_facts_are_told_apart_where_they_are_dealt(spark, wh, large):
    """Facts have an order: it is compared as it is, not as null-safe keys that no bucket has."""
    changed = spark.range(5).selectExpr("CAST(id AS string) AS order_id")
    for how in ("left_semi", "left_anti"):
        plan = final_plan(curated.facts_of_orders(wh.facts(), changed, how))
        assert "Bucketed: true" in plan
        assert len(shuffled_by(plan)) == 1  # the changed orders


# --- disk -----------------------------------------------------------------------------------


def shuffle_files(spark):
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    return [f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]


def wait_for(condition):
    """Files are deleted in the background."""
    end = time.time() + 30
    while not condition() and time.time() < end:
        time.sleep(0.2)
    return condition()


def test_a_write_leaves_no_files_of_its_shuffles(spark, tmp_path, large):
    setting, before = spark.conf.get(DROP_SHUFFLES, None), set(shuffle_files(spark))
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS string) AS k")
    joined = df.join(df.selectExpr("k", "id AS other").filter("other < 20"), "k")
    write_files(joined, str(tmp_path / "a"), ("k", "id", "other"))
    write_bucketed(df, str(tmp_path / "b"), "k", 4)
    forget(spark, str(tmp_path / "b"))
    assert wait_for(lambda: set(shuffle_files(spark)) <= before)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_files(df, str(tmp_path / "a"))
    assert spark.conf.get(DROP_SHUFFLES, None) == setting  # also after a failure
    assert read_files(spark, str(tmp_path / "a")).count() == joined.count()
    assert set(shuffle_files(spark)) - before  # what is not written can be collected again


@pytest.mark.parametrize("change", [{}, {"customers": [{"customer_id": "c1", "customer_state": "RJ"}] * 2}], ids=["plain", "repeated"])
def test_a_refresh_leaves_its_tables_and_nothing_else(spark, tmp_path, large, change):
    root, raw = str(tmp_path / "wh"), raw_tables(spark, **(MARKET | change))
    refresh(spark, raw, root, summaries=True)
    path = f"{root}/{current(spark, root)}"
    assert set(storage.names(spark, path)) == {
        *TABLES, curated.FACTS, curated.GRAINS, curated.BITMAPS, curated.SKETCHES, curated.MANIFEST,
    }
    wanted = curate(raw, "order_items")
    written = read_files(spark, f"{path}/order_items").select(*wanted.columns)
    assert sorted(rows(written), key=str) == sorted(rows(wanted), key=str)


# --- loading by file ------------------------------------------------------------------------


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


HEAD = "product_category_name,product_category_name_english\n"


def loaded(spark, lake):
    path = f"{lake}/category_translation"
    return sorted(rows(lakes.read_parts(spark, path, current(spark, path), "product_category_name string, product_category_name_english string")))


def test_only_new_and_changed_files_are_read(spark, tmp_path, monkeypatch):
    from parcelwatch.plans import ingest as module

    source, lake = tmp_path / "in" / "category_translation.csv", str(tmp_path / "lake")
    read = []
    plain = module.write_csv
    monkeypatch.setattr(module, "write_csv", lambda s, files, *a: read.append(sorted(f.rpartition("/")[2] for f in files)) or plain(s, files, *a))
    go = lambda: load_files(spark, str(source), lake, "category_translation")
    write(source / "a b.csv", HEAD + "a,1\n")
    write(source / "b.csv", HEAD + "b,2\nb,2\n")
    write(source / "empty.csv", HEAD)
    assert go() == ("loaded", 3, 3, 0, 0)
    assert go() == ("unchanged", 3, 0, 3, 0)
    write(source / "b.csv", HEAD + "b,33\n")
    write(source / "c.csv", HEAD + 'c,"line\nbreak"\n')
    assert go() == ("loaded", 3, 2, 2, 0)
    assert read == [["a b.csv", "b.csv", "empty.csv"], ["b.csv", "c.csv"]]
    assert loaded(spark, lake) == [("a", "1"), ("b", "33"), ("c", "line\nbreak")]
    (source / "a b.csv").unlink()
    assert go() == ("loaded", 2, 0, 3, 1)
    assert loaded(spark, lake) == [("b", "33"), ("c", "line\nbreak")]
    versions = lakes.folders(spark, f"{lake}/category_translation", current(spark, f"{lake}/category_translation"))
    assert len(versions) == 1


@pytest.mark.parametrize(
    "body",
    [
        "a,1\nb,2\n",
        'a,"1\n2"\n',
        HEAD + "a,1\n",  # a row like the header is a row
        "\n\na,1\r\n",
        '"a","x ""y"" z"\n',
    ],
)
def test_one_pass_reads_what_the_record_reader_reads(spark, tmp_path, body):
    from parcelwatch.sources.csv_files import read_csv, write_csv

    file = tmp_path / "t.csv"
    write(file, HEAD + body)
    n = write_csv(spark, [str(file)], "category_translation", str(tmp_path / "out"))
    got = sorted(rows(spark.read.parquet(str(tmp_path / "out")).drop(lakes.SOURCE)))
    assert got == sorted(rows(read_csv(spark, str(file), "category_translation"))) and len(got) == n


def test_clean_up_spares_files_a_newer_load_goes_on_using(spark, inputs, tmp_path):
    from parcelwatch.plans.curated import clean_lake

    source, lake, root = (str(tmp_path / n) for n in ("in", "lake", "wh"))
    for table, df in inputs.raw.items():
        df.write.csv(f"{source}/{table}.csv", header=True, escape='"')
    ingest(spark, source, lake)
    refresh(spark, lake_tables(spark, lake), root)
    inputs.raw["sellers"].limit(3).coalesce(1).write.mode("append").csv(f"{source}/sellers.csv", header=True, escape='"')
    again = {r.table: r for r in ingest(spark, source, lake).collect()}
    assert (again["sellers"].status, again["orders"].status) == ("loaded", "unchanged")
    outcome = clean_lake(spark, lake, root)
    assert outcome.pop("sellers") == "kept: shared with a newer load"
    assert set(outcome.values()) == {"deleted"}
    path = f"{lake}/sellers"
    assert lakes.read_parts(spark, path, current(spark, path), "seller_id string").count() == inputs.raw["sellers"].count() + 3
