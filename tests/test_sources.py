"""CSV ingest, lake and published tables."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from helpers import final_plan, item, order, planned, raw_table, raw_tables, review, rows

from parcelwatch import job
from parcelwatch.operators.fanout import ITEM_KEYS
from parcelwatch.params import Params
from parcelwatch.plans.curated import LakeTables, Warehouse, clean_lake, lake_tables, refresh
from parcelwatch.plans.ingest import ingest, loaded_share
from parcelwatch.plans.reports import PER_ORDER, REPORTS
from parcelwatch.schemas import RAW, SORT_KEYS, TABLES, curated_columns
from parcelwatch.sources import records, storage
from parcelwatch.sources.csv_files import read_csv
from parcelwatch.sources.tables import (
    expire,
    new_version,
    read_table,
    write_files,
    write_table,
)


def write(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def header(table: str) -> str:
    return ",".join(RAW[table]) + "\n"


def counts(report):
    return {r["table"]: (r["status"], r["rows"]) for r in report.collect()}


# --- CSV ---


def test_columns_are_bound_by_name(spark, tmp_path):
    text = " Seller State ,SELLER_ID,seller_city,extra,seller_zip_code_prefix\nSP,s1,x,y,01037\n"
    df = read_csv(spark, write(tmp_path / "sellers.csv", text), "sellers")
    row = df.first()
    assert row["seller_id"] == "s1"
    assert row["seller_state"] == "SP"
    assert row["seller_zip_code_prefix"] == 1037  # a number, so the leading zero goes
    assert row["extra"] == "y"


def test_missing_column_is_refused(spark, tmp_path):
    path = write(tmp_path / "sellers.csv", "seller_id\ns1\n")
    with pytest.raises(ValueError, match="seller_state"):
        read_csv(spark, path, "sellers")


def test_review_text_with_breaks_quotes_and_commas(spark, tmp_path):
    message = 'linha um\nlinha "dois", fim'
    quoted = message.replace('"', '""')
    text = header("order_reviews") + f'r1,a,5,,"{quoted}",d,t\nr2,b,1,NA,nan,d,t\n'
    df = read_csv(spark, write(tmp_path / "r.csv", text), "order_reviews")
    assert sorted(rows(df)) == [
        ("r1", "a", 5, None, message, "d", "t"),
        ("r2", "b", 1, None, None, "d", "t"),
    ]


@pytest.fixture
def long_reviews(tmp_path):
    """Two files of reviews whose texts hold breaks, quotes and commas."""
    folder = tmp_path / "order_reviews.csv"
    folder.mkdir()
    texts = [
        "ok",
        'linha um\nlinha "dois", fim',
        "\n\nvazio\n",
        "",
        '"',
        "a,b",
        "x\r\ny",
        "word " * 300 + "\n" + "tarde\n" * 200,
    ]
    for name in ("a", "b"):
        with open(folder / f"{name}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\r\n" if name == "b" else "\n")
            writer.writerow(RAW["order_reviews"])
            for n in range(200):
                text = texts[n % len(texts)]
                writer.writerow([f"{name}{n}", f"o{n}", 1 + n % 5, f"t{n}", text, "d", "t"])
    return str(folder)


@pytest.mark.parametrize("block", ["1KB", "3000", "50KB", "128MB"])
def test_long_files_are_split_inside_records(spark, long_reviews, conf, block):
    whole = sorted(map(repr, rows(read_csv(spark, long_reviews, "order_reviews"))))
    assert len(whole) == 400
    assert "\\r" not in "".join(whole)
    conf(spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="0")
    split = read_csv(spark, long_reviews, "order_reviews")
    assert sorted(map(repr, rows(split))) == whole
    lines = spark.read.text(long_reviews, lineSep="\n")
    assert block == "128MB" or lines.rdd.getNumPartitions() > 2


def test_patterns_are_tried_on_lines_that_hold_their_sign_only(spark, tmp_path):
    """Lines without quotes and CRs cost two searches for a sign; the answers are those of the patterns."""
    texts = ["", "a,b", 'a,"b', 'a,"b"', 'b",c', 'b","c', '""', '"', "a\r", "a\r\r", "\ra", 'a,"b\r', "a\r\u2028"]
    lines = spark.createDataFrame([(x,) for x in texts], "value string")
    line, plain = records._unended("value"), F.regexp_replace("value", r"\r$", "")
    want = lines.select(plain, plain.rlike(records._OPENS), plain.rlike(records._STAYS) | plain.rlike(records._REOPENS))
    assert rows(lines.select(line, records._opens(line), records._stays(line))) == rows(want)
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n")
    plan = planned(records.read_lines(spark, [str(path)], "a,b", Observation()))
    assert "Contains(value" in plan and "Contains(text" in plan


def test_a_quoted_value_without_end_is_refused(spark, tmp_path):
    path = write(tmp_path / "r.csv", header("order_reviews") + 'r1,a,5,t,"no end,d,t\n')
    with pytest.raises(Exception, match="no end"):
        read_csv(spark, path, "order_reviews").collect()


@pytest.mark.parametrize("block", ["1KB", "3000", "128MB"])
def test_odd_files_read_as_the_whole_file_reader_does(spark, tmp_path, conf, block):
    conf(spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="0")
    cells = ['5" tv', 'ok"', '"a ""b"" c"', '"x\ny"', '"1\n\n2, 3"', "", "plain", '"q"', '"end ""\nnext"']
    for end in ("\n", "\r\n"):
        lines = [f"s{n},{n},{cells[n * 7 % len(cells)]},{cells[n % len(cells)]}" for n in range(300)]
        lines[50:50] = ["", ""]  # blank lines are no rows
        text = header("sellers").strip() + end + end.join(lines) + end
        path = tmp_path / f"{block}{len(end)}.csv"
        path.write_text(text, newline="")
        got = read_csv(spark, str(path), "sellers")
        missing = lambda v: None if v in ("", None) else str(v)
        want = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(path))
        assert sorted(repr(tuple(map(missing, r))) for r in rows(got)) == sorted(
            repr(tuple(map(missing, r))) for r in rows(want)
        )
        assert got.count() == 300


def test_each_file_is_bound_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "sellers.csv"
    folder.mkdir()
    write(folder / "a.csv", header("sellers") + "s1,1,x,SP\n")
    write(folder / "b.csv", "seller_state,seller_city,extra,seller_id,seller_zip_code_prefix\nRJ,y,e,s2,2\n")
    got = {r.seller_id: (r.seller_state, r.seller_city, r.extra) for r in read_csv(spark, str(folder), "sellers").collect()}
    assert got == {"s1": ("SP", "x", None), "s2": ("RJ", "y", "e")}
    write(folder / "c.csv", "seller_id\ns3\n")
    with pytest.raises(ValueError, match="c.csv: no column"):
        read_csv(spark, str(folder), "sellers")


def test_unreadable_number_stops_the_run(spark, tmp_path):
    text = header("order_payments") + "a,one,card,1,2.5\n"
    df = read_csv(spark, write(tmp_path / "p.csv", text), "order_payments")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.collect()


# --- ingest ---


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    write(folder / "sellers.csv", header("sellers") + "s1,1,x,SP\ns2,2,y,RJ\n")
    write(folder / "mql.csv", header("mql") + "m1,2018-01-01,,\n")
    return str(folder)


def test_ingest_reports_counts_and_skips_absent_files(spark, source, tmp_path):
    report = ingest(spark, source, str(tmp_path / "lake"))
    found = counts(report)
    assert found["sellers"] == ("loaded", 2)
    assert found["mql"] == ("loaded", 1)
    assert found["orders"] == ("skipped", None)
    assert rows(loaded_share(report)) == [(2, len(TABLES))]


def test_ingest_again_does_not_double_rows(spark, source, tmp_path):
    lake = str(tmp_path / "lake")
    ingest(spark, source, lake)
    ingest(spark, source, lake)
    assert read_table(spark, lake, "sellers").count() == 2


def test_required_table_must_exist(spark, source, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest(spark, source, str(tmp_path / "lake"), required=["orders"])


def test_a_folder_of_files_is_one_table(spark, tmp_path):
    folder = tmp_path / "source" / "sellers.csv"
    folder.mkdir(parents=True)
    for n in range(3):
        write(folder / f"part{n}.csv", header("sellers") + f"s{n},1,x,SP\n")
    report = ingest(spark, str(tmp_path / "source"), str(tmp_path / "lake"))
    assert counts(report)["sellers"] == ("loaded", 3)


# --- tables ---


def test_failed_write_keeps_the_old_table(spark, tmp_path):
    root = str(tmp_path)
    write_table(raw_table(spark, "sellers", [{"seller_id": "old"}]), root, "sellers")
    broken = spark.sql("SELECT raise_error('broken') AS seller_id")
    with pytest.raises(Exception, match="broken"):
        write_table(broken, root, "sellers")
    assert read_table(spark, root, "sellers").first()["seller_id"] == "old"


def test_readers_keep_their_version_and_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    write_table(raw_table(spark, "sellers", [{"seller_id": "old"}]), root, "sellers")
    before = read_table(spark, root, "sellers")
    files = sorted(str(p) for p in tmp_path.rglob("*"))
    before.collect()
    assert sorted(str(p) for p in tmp_path.rglob("*")) == files
    write_table(raw_table(spark, "sellers", [{"seller_id": "new"}]), root, "sellers")
    assert before.first()["seller_id"] == "old"
    assert read_table(spark, root, "sellers").first()["seller_id"] == "new"


def test_old_versions_expire_but_not_unfinished_ones(spark, tmp_path):
    root = str(tmp_path)
    paths = [write_table(spark.range(n).toDF("id"), root, "t") for n in range(1, 5)]
    later = f"{root}/t/{new_version()}"
    write_files(spark.range(9).toDF("id"), later)  # a write that has not published yet
    gone = expire(spark, f"{root}/t", spare=1)
    assert [f"{root}/t/{v}" for v in gone] == paths[:2]
    assert storage.exists(spark, later)
    assert read_table(spark, root, "t").count() == 4


def test_table_can_be_replaced_by_a_query_on_itself(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.range(10).toDF("id"), root, "t", ["id"])
    write_table(read_table(spark, root, "t").filter("id < 4"), root, "t", ["id"])
    assert read_table(spark, root, "t").count() == 4


def test_files_are_sorted_and_hot_keys_are_split(spark, tmp_path, conf):
    conf(
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="16KB",
        spark__sql__shuffle__partitions="24",
    )
    # one key holds a third of the rows
    key = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 50 END AS k"
    df = spark.range(0, 60000, numPartitions=8).selectExpr(key, "id", "uuid() AS x")
    write_table(df, str(tmp_path), "t", ["k", "id"])
    back = read_table(spark, str(tmp_path), "t")
    assert back.count() == 60000
    per_file = back.selectExpr("input_file_name() AS f", "k", "id")
    spans = per_file.groupBy("f").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    spans = sorted((r.low, r.high) for r in spans.collect())
    # files follow each other: only the ends of neighbours may be equal
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    hot = per_file.filter("k = 'hot'").groupBy("f").count().collect()
    assert len(hot) > 3
    assert max(r["count"] for r in hot) < 20000 / 2
    for part in per_file.select("f").distinct().limit(3).collect():
        stored = spark.read.parquet(part["f"]).select("k", "id").collect()
        assert stored == sorted(stored)


def test_partition_folders(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS m")
    path = write_table(df, str(tmp_path), "t", ["m", "id"], partition_by=["m"])
    assert storage.exists(spark, f"{path}/m=1")
    assert read_table(spark, str(tmp_path), "t", ["id"]).count() == 10


# --- refresh ---


@pytest.fixture
def lake(spark, tmp_path):
    raw = raw_tables(
        spark,
        orders=[order("a", days=(0, 0, 1, 20, 10)), order("b")],
        order_items=[item("a"), item("b", "s2")],
        order_reviews=[review("a", 1, "tarde"), review("zzz", 3)],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}],
    )
    root = str(tmp_path / "lake")
    for table in TABLES:
        write_table(raw[table], root, table)
    return root


def contents(wh):
    return {t: sorted(map(str, rows(wh.table(t)))) for t in TABLES}


def test_refresh_equals_the_computed_tables_and_can_be_repeated(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    raw = lake_tables(spark, lake)
    report = dict(rows(refresh(spark, raw, root)))
    assert set(report) == set(TABLES)
    assert report["order_items"] == 2
    wh = Warehouse.published(spark, root)
    first = contents(wh)
    assert first == contents(Warehouse.computed(raw))
    refresh(spark, lake_tables(spark, lake), root)
    assert contents(wh) == first
    for table in TABLES:
        assert tuple(wh.table(table).columns) == curated_columns(table)
        assert set(SORT_KEYS[table]) <= set(curated_columns(table))


def test_lake_is_cleaned_only_after_publishing(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    before = clean_lake(spark, lake, root)
    assert set(before.values()) == {"kept: not published yet"}
    refresh(spark, lake_tables(spark, lake), root)
    assert set(clean_lake(spark, lake, root).values()) == {"deleted"}
    assert set(clean_lake(spark, lake, root).values()) == {"absent"}
    assert Warehouse.published(spark, root).table("orders").count() == 2


def test_reports_are_the_same_with_and_without_published_facts(spark, inputs, tmp_path):
    root = str(tmp_path / "warehouse")
    refresh(spark, inputs.raw, root)
    wh = Warehouse.published(spark, root)
    joined = wh.without_facts()
    for name, report in REPORTS.items():
        assert rows(report(wh)) == rows(report(joined)), name
    for name in PER_ORDER:
        assert rows(REPORTS[name](wh, per_order=True)) == rows(
            REPORTS[name](joined, per_order=True)
        ), name
    for name in ("sla_distribution", "problem_sellers"):
        plan = final_plan(REPORTS[name](wh))
        assert "Join" not in plan
        assert "delivery_grains" in plan and "delivery_facts" not in plan and "/order" not in plan
    refresh(spark, inputs.raw, root, facts=False)
    late = Warehouse.published(spark, root)
    assert "Join" in final_plan(REPORTS["problem_sellers"](late))
    assert wh.facts("category").columns[:2] == ["order_id", "category"]  # joined afresh


def fewer_orders(spark, lake):
    raw = lake_tables(spark, lake)
    some = LakeTables(raw, raw.versions)
    some["orders"] = raw["orders"].filter("order_id = 'a'")
    return some


def test_a_failed_refresh_leaves_one_consistent_version(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    refresh(spark, lake_tables(spark, lake), root)
    before = contents(Warehouse.published(spark, root))
    broken = fewer_orders(spark, lake)
    broken["order_items"] = broken["order_items"].withColumn("price", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        refresh(spark, broken, root)
    wh = Warehouse.published(spark, root)
    assert contents(wh) == before
    assert rows(wh.facts(*ITEM_KEYS).agg(F.count_distinct("order_id"))) == [(2,)]


def test_two_refreshes_at_once_publish_one_of_them_whole(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    refresh(spark, lake_tables(spark, lake), root)
    reader = Warehouse.published(spark, root)
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(refresh, spark, raw, root) for raw in (fewer_orders(spark, lake), lake_tables(spark, lake))]
        for run in runs:
            run.result()
    assert reader.table("orders").count() == 2  # its version is still there
    wh = Warehouse.published(spark, root)
    orders = wh.table("orders").count()
    assert wh.facts(*ITEM_KEYS).select("order_id").distinct().count() == orders


def test_clean_up_is_all_or_nothing_and_spares_newer_loads(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    raw = lake_tables(spark, lake)
    refresh(spark, raw, root, facts=False)
    assert set(clean_lake(spark, lake, root).values()) == {"kept: not published yet"}
    refresh(spark, raw, root)
    write_table(raw_table(spark, "sellers", [{"seller_id": "s7"}]), lake, "sellers")
    outcome = clean_lake(spark, lake, root)
    assert set(outcome.values()) == {"deleted"}
    assert read_table(spark, lake, "sellers").first()["seller_id"] == "s7"
    assert clean_lake(spark, lake, root)["sellers"] == "kept: newer than the warehouse"


def test_table_parameters_act_or_are_refused(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    made = Params(impute_missing=False, delay_keywords=("tarde",))
    refresh(spark, lake_tables(spark, lake), root, made)
    wh = Warehouse.published(spark, root)
    assert wh.params == made
    assert REPORTS["delay_vs_score"](wh).count() >= 0
    with pytest.raises(ValueError, match="impute_missing, delay_keywords"):
        REPORTS["delay_vs_score"](wh, Params())


def test_tables_have_names(spark, lake, tmp_path):
    root = str(tmp_path / "warehouse")
    refresh(spark, lake_tables(spark, lake), root)
    views = Warehouse.published(spark, root).register(spark, "market_")
    assert len(views) == 13
    assert spark.sql("SELECT count(*) FROM market_orders").first()[0] == 2


def test_the_job_runs_its_stages_in_order(spark, inputs, tmp_path):
    source, lake, root = (str(tmp_path / n) for n in ("source", "lake", "warehouse"))
    for table, df in inputs.raw.items():
        df.write.csv(f"{source}/{table}.csv", header=True, escape='"')
    cleaned = job.main([source, lake, root])
    assert set(cleaned.values()) == {"deleted"}
    wh = Warehouse.published(spark, root)
    assert wh.table("orders").count() == inputs.raw["orders"].count()
    with pytest.raises(FileNotFoundError, match="nothing loaded"):
        lake_tables(spark, lake)
