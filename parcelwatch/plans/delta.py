"""Refresh by difference: a new warehouse version from the orders that changed in the lake.

Two lake versions are compared by hashes of their rows, and only in files that one of them has and
the other has not. An order has changed if a row of it, or of its customer, sellers or products,
came, went or differs. The new version holds the rows of those orders and a list of them; for all
others it reads the version before, and tables without orders are written again only if they
changed. The measures of the reports are sums over orders, so those of the changed orders are taken
away as they were and added as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelwatch.operators import grains
from parcelwatch.params import Params
from parcelwatch.plans.curated import (
    BY_ORDER,
    CHANGED,
    FACTS,
    GRAINS,
    LakeTables,
    Warehouse,
    curate,
    facts_of,
    facts_of_orders,
    lake_tables,
    manifest,
    of_orders,
    refresh,
    versions_read,
    write_curated,
    write_facts,
    write_grains,
    write_manifest,
)
from parcelwatch.schemas import RAW, TABLES, raw_schema
from parcelwatch.session import shuffles_dropped
from parcelwatch.sources import lake as lakes
from parcelwatch.sources.tables import current, new_version, read_files, table_path, write_files

#: Versions that read from one another; a longer chain is made one by a full refresh.
MAX_CHAIN = 8


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of `key` whose rows are not the same, as often, in both frames.

    Rows are told apart by two hashes. They are counted on the map side, so a key that many
    unchanged rows have sends a row a task and distinct row.
    """
    columns = [c for c in new.columns if c in old.columns]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        hashes = (F.xxhash64(*columns).alias("h"), F.hash(*reversed(columns)).alias("g"))
        return df.select(F.col(key).alias("key"), *hashes, F.lit(sign).alias("sign"))

    rows = signed(old.select(*columns), -1).unionAll(signed(new.select(*columns), 1))
    counts = rows.groupBy("key", "h", "g").agg(F.sum("sign").alias("n"))
    return counts.filter("n != 0").select(F.col("key").alias(key)).distinct()


def lake_difference(spark: SparkSession, old: LakeTables, new: LakeTables) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Of each table that has another version: rows of files only one of the versions has."""
    found = {}
    for table in TABLES:
        before, after = old.versions[table], new.versions[table]
        if before == after and old.lake == new.lake:
            continue
        paths = [table_path(lake, table) for lake in (old.lake, new.lake)]
        sides = [lakes.parts(spark, p, v) for p, v in zip(paths, (before, after), strict=True)]
        both = sides[0] & sides[1] if old.lake == new.lake else set()
        frames = [
            lakes.read_parts(spark, p, v, raw_schema(table), side - both)
            for p, v, side in zip(paths, (before, after), sides, strict=True)
        ]
        found[table] = (frames[0], frames[1])
    return found


def changed_orders(difference: dict[str, tuple[DataFrame, DataFrame]], old: LakeTables, new: LakeTables) -> DataFrame:
    """Orders any of whose rows changed, or whose customer, sellers or products did."""
    found: list[DataFrame] = []

    def looked_up(keys: DataFrame, key: str, table: str, wanted: str) -> DataFrame:
        rows = old[table].select(key, wanted).unionAll(new[table].select(key, wanted))
        return rows.join(keys, key, "left_semi").select(wanted).distinct()

    for table in BY_ORDER:
        if table in difference:
            found.append(changed_keys(*difference[table], "order_id"))
    products = [changed_keys(*difference["products"], "product_id")] if "products" in difference else []
    if "category_translation" in difference:
        name = "product_category_name"
        products.append(looked_up(changed_keys(*difference["category_translation"], name), name, "products", "product_id"))
    found += [looked_up(keys, "product_id", "order_items", "order_id") for keys in products]
    if "sellers" in difference:
        sellers = changed_keys(*difference["sellers"], "seller_id")
        found.append(looked_up(sellers, "seller_id", "order_items", "order_id"))
    if "customers" in difference:
        customers = changed_keys(*difference["customers"], "customer_id")
        found.append(looked_up(customers, "customer_id", "orders", "order_id"))
    return _union(found).distinct() if found else new["orders"].select("order_id").limit(0)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for one in rest:
        first = first.unionAll(one)
    return first


def refresh_changed(spark: SparkSession, raw: LakeTables, root: str) -> DataFrame:
    """Publish the lake tables as a version that holds only what changed since the current one.

    The same rows as a full refresh with the parameters of the current version. Bitmaps and
    sketches are not carried on. Nothing published, the lake versions it was made from gone, or
    MAX_CHAIN versions that read from one another: a full refresh. Returns a row per table.
    """
    root = root.rstrip("/")
    now = current(spark, root)
    made = manifest(spark, root, now) if now else None
    params = Params.from_tables(made["params"] | made["grains"]) if made else Params()
    if not made or FACTS not in made["schemas"] or len(versions_read(spark, root)) >= MAX_CHAIN:
        return refresh(spark, raw, root, params)
    try:
        old = lake_tables(spark, raw.lake, made["lake"])
    except FileNotFoundError:
        return refresh(spark, raw, root, params)

    version = new_version()
    path = f"{root}/{version}"
    difference = lake_difference(spark, old, raw)
    write_files(changed_orders(difference, old, raw), table_path(path, CHANGED))
    changed = read_files(spark, table_path(path, CHANGED), None, "order_id string")
    before = Warehouse._of_version(spark, root, now, made)

    whole = [
        t for t in difference
        if t not in BY_ORDER and not _same_rows(*difference[t], RAW[t])
    ]
    fresh = {
        "base": now, "whole": whole, "params": made["params"], "grains": made["grains"],
        "lake": dict(raw.versions), "buckets": made["buckets"], "schemas": {},
        "rows": dict(made["rows"]), "repeats": dict(made["repeats"]),
    }
    own = dict(raw) | {t: of_orders(raw[t], changed) for t in BY_ORDER}
    for table in (*BY_ORDER, *whole):
        counted = Observation(table)
        write_curated(curate(own, table, params), path, table, counted)
        gone = made["rows"][table]
        if table in BY_ORDER:
            with shuffles_dropped(spark):
                gone = of_orders(before.table(table, "order_id"), changed).count()
        fresh["rows"][table] += counted.get["rows"] - gone

    # out of the tables just written: their rows need not be found and joined again
    parts = Warehouse._of_version(spark, root, version, fresh | {"base": None, "whole": []})
    write_facts(facts_of(parts), path, fresh)
    come = Warehouse._of_version(spark, root, version, fresh | {"base": None, "whole": []}).facts()
    gone = facts_of_orders(before.facts(), changed)
    summed = grains.difference(before._published[GRAINS](), grains.all_grains(gone, params), grains.all_grains(come, params))
    write_grains(summed, path, fresh)
    return write_manifest(spark, root, version, fresh)


def _same_rows(old: DataFrame, new: DataFrame, columns: Iterable[str]) -> bool:
    first = next(iter(columns))
    with shuffles_dropped(old.sparkSession):
        return changed_keys(old, new, first).isEmpty()
