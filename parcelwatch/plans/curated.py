"""The eleven curated tables, computed lazily or read from their published copies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelwatch.operators import grains
from parcelwatch.operators.dedup import one_per_key
from parcelwatch.operators.distinct import BITMAP_KEYS, number_orders, order_bitmaps
from parcelwatch.operators.enrich import enrich_items, enrich_orders, enrich_reviews, pack_items, unpack_items
from parcelwatch.operators.fanout import ITEM_KEYS, STAGES, delivery_facts
from parcelwatch.operators.nulls import fill_missing
from parcelwatch.operators.sketches import STAGE_PAIR, stage_sketches
from parcelwatch.params import TABLE_FIELDS, Params
from parcelwatch.schemas import (
    LOOKUP_COLUMNS,
    LOOKUP_KEYS,
    PARTITIONS,
    SORT_KEYS,
    TABLES,
    curated_columns,
    curated_schema,
    raw_schema,
)
from parcelwatch.session import shuffles_dropped
from parcelwatch.sources import lake as lakes
from parcelwatch.sources import storage
from parcelwatch.sources.buckets import ddl, default_buckets, read_bucketed, write_bucketed
from parcelwatch.sources.tables import (
    current,
    new_version,
    publish,
    read_files,
    table_path,
    write_files,
)

Raw = Mapping[str, DataFrame]

# Published beside the eleven tables: the join most reports start from, and its measures.
FACTS = "delivery_facts"
GRAINS = "delivery_grains"
# On demand: what distinct counts and quantiles of any period are merged from.
BITMAPS = "order_bitmaps"
SKETCHES = "stage_sketches"
# Tables that a refresh by difference changes order by order, and where it lists those orders.
BY_ORDER = ("orders", "order_items", "order_reviews")
CHANGED = "changed_orders"
# Beside the tables of a version: what it was made of.
MANIFEST = "_manifest.json"


def curate(
    raw: Raw, table: str, params: Params = Params(), columns: Sequence[str] | None = None
) -> DataFrame:
    """One curated table from the raw ones. `columns` leaves out joins nobody needs."""
    wanted = tuple(columns or curated_columns(table))
    if table == "orders":
        df = enrich_orders(raw["orders"], params)
    elif table == "order_items":
        df = enrich_items(
            raw["order_items"],
            raw["orders"],
            raw["customers"],
            raw["sellers"],
            raw["products"],
            raw["category_translation"],
            wanted,
        )
    elif table == "order_reviews":
        df = enrich_reviews(raw["order_reviews"], enrich_orders(raw["orders"], params), params)
    elif table == "geolocation":
        df = one_per_key(
            raw[table].select(*curated_columns(table)), "geolocation_zip_code_prefix"
        )
    else:
        df = raw[table]
    return fill_missing(table, df.select(*wanted), params)


def facts_of(wh: Warehouse, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Delivery facts that can be grouped by `keys`, joined from the tables."""
    return delivery_facts(
        wh.table("order_items", "order_id", *keys, "price", "freight_value"),
        wh.table("orders", "order_id", "order_status", "is_late", *STAGES),
        wh.table("order_reviews", "order_id", "review_score"),
        keys,
    )


class Warehouse:
    """Curated tables by name, whatever they come from, and the parameters they were made with.

    `published` names frames that are published beside the tables (facts, grains, bitmaps,
    sketches); what is absent is computed from the tables when it is asked for.
    """

    def __init__(
        self,
        load: Callable[[str, Sequence[str] | None], DataFrame],
        published: Mapping[str, Callable[[], DataFrame]] | None = None,
        params: Params = Params(),
        grain_settings: Mapping | None = None,
    ):
        self._load, self._published, self.params = load, dict(published or {}), params
        self._grain_settings = grain_settings

    def table(self, name: str, *columns: str) -> DataFrame:
        return self._load(name, columns or None)

    def facts(self, *keys: str) -> DataFrame:
        """Delivery facts that can be grouped by `keys`: read if published so, else joined."""
        if FACTS in self._published and set(keys) <= set(ITEM_KEYS):
            return self._published[FACTS]()
        return facts_of(self, keys)

    def measures(
        self, grain: str, measures: Sequence[str], params: Params, counting: str = "joined"
    ) -> DataFrame:
        """Measures of the groups of a grain: read if published for such parameters, else summed."""
        if GRAINS in self._published and grains.settings(params) == self._grain_settings:
            return grains.read(self._published[GRAINS](), grain, measures, counting)
        facts = self.facts(*grains.GRAINS[grain].needs)
        return grains.compute(facts, grain, measures, counting, params)

    def bitmaps(self) -> DataFrame:
        """Orders as bits by month, states and seller; see `operators.distinct`."""
        if BITMAPS in self._published:
            return self._published[BITMAPS]()
        raise LookupError("order bitmaps are made by refresh(..., summaries=True)")

    def sketches(self) -> DataFrame:
        """Quantile sketches by month and stage: read if published, else made."""
        if SKETCHES in self._published:
            return self._published[SKETCHES]()
        orders = self.table("orders", "order_status", "order_month", *STAGE_PAIR)
        return stage_sketches(orders, self.params.delivered)

    def in_months(self, name: str, months: DataFrame, *columns: str) -> DataFrame:
        """Rows of a table in the `order_month`s of another frame.

        Published orders and reviews have a folder a month; the folders of other months are not
        read, whatever the months come from: they are looked up when the query runs.
        """
        return self.table(name, *columns).join(months.select("order_month").distinct(), "order_month", "left_semi")

    def without_facts(self) -> Warehouse:
        """The same tables; the facts are joined from them."""
        return Warehouse(self._load, None, self.params)

    def without_grains(self) -> Warehouse:
        """The same tables and facts; measures are summed from the facts."""
        kept = {k: v for k, v in self._published.items() if k != GRAINS}
        return Warehouse(self._load, kept, self.params)

    def agreed(self, params: Params | None) -> Params:
        """Report parameters that fit the tables; none given: those of the tables.

        Table parameters cannot act on finished tables, so another value is refused.
        """
        if params is None:
            return self.params
        odd = [f for f in TABLE_FIELDS if getattr(params, f) != getattr(self.params, f)]
        if odd:
            raise ValueError(f"the tables were made with other values of {', '.join(odd)}")
        return params

    def register(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Name the tables for SQL: a temporary view for each, of the version read here."""
        views = []
        for name in (*TABLES, *self._published):
            df = self.table(name) if name in TABLES else self._published[name]()
            df.createOrReplaceTempView(f"{prefix}{name}")
            views.append(f"{prefix}{name}")
        return views

    @classmethod
    def computed(cls, raw: Raw, params: Params = Params()) -> Warehouse:
        return cls(lambda name, columns: curate(raw, name, params, columns), None, params)

    @classmethod
    def published(cls, spark: SparkSession, root: str) -> Warehouse:
        """The current version, resolved once: tables, facts and parameters belong together."""
        root = root.rstrip("/")
        version = current(spark, root)
        if version is None:
            raise FileNotFoundError(f"{root}: nothing published")
        return cls._of_version(spark, root, version, manifest(spark, root, version))

    @classmethod
    def _of_version(cls, spark: SparkSession, root: str, version: str, made: dict) -> Warehouse:
        path = f"{root}/{version}"
        base = made.get("base")
        if base:
            before = cls._of_version(spark, root, base, manifest(spark, root, base))
            changed = read_files(spark, table_path(path, CHANGED), schema="order_id string")

        def load(name: str, columns: Sequence[str] | None) -> DataFrame:
            if base and name not in made["whole"] and name not in BY_ORDER:
                return before.table(name, *(columns or ()))
            wanted = tuple(columns or curated_columns(name))
            own = read_files(spark, table_path(path, name), None, curated_schema(name))
            if not base or name not in BY_ORDER:
                return own.select(*wanted)
            kept = without_orders(before.table(name, *dict.fromkeys((*wanted, "order_id"))), changed)
            return kept.select(*wanted).unionByName(own.select(*wanted))

        def facts() -> DataFrame:
            own = read_bucketed(
                spark, table_path(path, FACTS), made["schemas"][FACTS], "order_id", made["buckets"]
            )
            return facts_of_orders(before.facts(), changed, "left_anti").unionByName(own) if base else own

        def plain(name: str) -> Callable[[], DataFrame]:
            return lambda: read_files(spark, table_path(path, name), None, made["schemas"][name])

        frames = {n: facts if n == FACTS else plain(n) for n in made["schemas"]}
        return cls(load, frames, Params.from_tables(made["params"]), made["grains"])


def of_orders(df: DataFrame, changed: DataFrame) -> DataFrame:
    return df.join(changed, _same_order(df, changed), "left_semi")


def without_orders(df: DataFrame, changed: DataFrame) -> DataFrame:
    return df.join(changed, _same_order(df, changed), "left_anti")


def facts_of_orders(facts: DataFrame, changed: DataFrame, how: str = "left_semi") -> DataFrame:
    """As `of_orders` or `without_orders`: facts have an order, so they stay where they are dealt."""
    return facts.join(changed, "order_id", how)


def _same_order(df: DataFrame, changed: DataFrame) -> Column:
    return df["order_id"].eqNullSafe(changed["order_id"])


class LakeTables(dict):
    """Raw tables by name, and the lake version each of them was read from."""

    def __init__(self, tables: Raw, versions: Mapping[str, str], lake: str | None = None):
        super().__init__(tables)
        self.versions, self.lake = dict(versions), lake


def lake_tables(
    spark: SparkSession, lake: str, versions: Mapping[str, str] | None = None
) -> LakeTables:
    """The raw tables of the lake: the current version of each, or the given ones."""
    lake = lake.rstrip("/")
    versions = versions or {t: current(spark, table_path(lake, t)) for t in TABLES}
    absent = [t for t, v in versions.items() if not v or not storage.exists(spark, f"{lake}/{t}/{v}")]
    if absent:
        raise FileNotFoundError(f"{lake}: nothing loaded for {', '.join(absent)}")
    tables = {
        t: lakes.read_parts(spark, table_path(lake, t), versions[t], raw_schema(t)) for t in TABLES
    }
    return LakeTables(tables, versions, lake)


def manifest(spark: SparkSession, root: str, version: str) -> dict:
    """What a published version is made of: table rows, facts, parameters, lake versions."""
    return json.loads(storage.read_text(spark, f"{root}/{version}/{MANIFEST}"))


def versions_read(spark: SparkSession, root: str) -> list[str]:
    """The current version and those it reads from: what must not be expired."""
    root, found = root.rstrip("/"), []
    version = current(spark, root)
    while version:
        found.append(version)
        version = manifest(spark, root, version).get("base")
    return found


def write_manifest(spark: SparkSession, root: str, version: str, made: dict) -> DataFrame:
    """Publish a version whose tables are written; returns a row per table with its rows."""
    storage.write_text(spark, f"{root}/{version}/{MANIFEST}", json.dumps(made))
    publish(spark, root, version)
    return spark.createDataFrame(list(made["rows"].items()), "table string, rows bigint")


def write_curated(
    df: DataFrame,
    path: str,
    table: str,
    counted: Observation | None = None,
    made_of: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One curated table in its published layout."""
    key, folders = SORT_KEYS[table], PARTITIONS.get(table, ())
    write_files(df, table_path(path, table), key, folders, LOOKUP_COLUMNS.get(table, ()), counted, made_of)


@contextmanager
def joined(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """The rows of `df`, written for as long as the block lasts.

    The files of their shuffles are gone before they are shuffled once more, to be sorted, and
    the joins are made once: a sort by ranges reads its rows twice.
    """
    write_files(df, path)
    try:
        yield read_files(df.sparkSession, path, None, ddl(df))
    finally:
        storage.delete(df.sparkSession, path)


def repeated_keys(df: DataFrame, key: str) -> dict[str, int]:
    """How many values of a lookup key are there more than once, and how many rows too many.

    Counted per key on the map side first. A missing key never joins, so it is no repeat.
    """
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = per_key.filter("n > 1").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("rows"))
    with shuffles_dropped(df.sparkSession):
        row = found.first()
    return {"keys": row["keys"], "rows": row["rows"] or 0}


def refresh(
    spark: SparkSession,
    raw: Raw,
    root: str,
    params: Params = Params(),
    facts: bool = True,
    summaries: bool = False,
    buckets: int | None = None,
    refuse_repeats: bool = False,
) -> DataFrame:
    """Publish all curated tables as one version; returns a row per table with its rows.

    Orders are enriched once: reviews and items take their context from the written orders. The
    other tables do not depend on each other and are written side by side. With `facts` the join of
    items, orders and reviews is written too, dealt into `buckets` by order, and the measures of
    all groupings of the reports. With `summaries` bitmaps and sketches are, from which distinct
    counts and quantiles of any period are merged. Readers see the new version when all of it is
    written; a failure leaves the old one.

    Lookup keys are counted while the tables are written. A repeated key multiplies the rows that
    look it up: the manifest tells how many there are, or `refuse_repeats` stops before publishing.
    Items are written after the lookups: where keys repeat, they are multiplied behind their sort.
    The files of a table's shuffles are deleted when it is written, so no two steps add up on disk.
    """
    root, version = root.rstrip("/"), new_version()
    path = f"{root}/{version}"
    made = {"base": None, "params": params.of_tables(), "rows": {}, "repeats": {}, "schemas": {}}
    made |= {"lake": dict(getattr(raw, "versions", {})), "grains": grains.settings(params)}
    made["buckets"] = buckets or default_buckets(spark)
    fresh = Warehouse._of_version(spark, root, version, made)

    def looked_up() -> dict[str, DataFrame]:
        """Items and what they look up; in written tables, whose size Spark knows, if none of it is filled there."""
        return dict(raw) | {t: fresh.table(t) for t in ("orders", "customers", "sellers")}

    def curated(table: str) -> None:
        made_of = None
        if table == "order_reviews":
            df = enrich_reviews(raw[table], fresh.table("orders"), params)
            df = fill_missing(table, df, params)
        elif table == "order_items" and any(n["keys"] for n in made["repeats"].values()):
            repeated = [t for t, n in made["repeats"].items() if n["keys"]]
            tables = looked_up()
            df = pack_items(tables[table], tables["orders"], *[tables[t] for t in LOOKUP_KEYS], repeated)
            made_of = lambda rows: fill_missing(table, unpack_items(rows), params)
        else:
            df = curate(looked_up() if table == "order_items" else raw, table, params)
        counted = Observation(table)
        if table == "order_items":
            with joined(df, table_path(path, "joined_items")) as df:
                write_curated(df, path, table, counted, made_of)
        else:
            write_curated(df, path, table, counted, made_of)
        made["rows"][table] = counted.get["rows"]
        if table in LOOKUP_KEYS:
            key = LOOKUP_KEYS[table]
            made["repeats"][table] = repeated_keys(fresh.table(table, key), key)

    looked_up_later = ("order_items", "order_reviews")
    with ThreadPoolExecutor(max_workers=4) as pool:
        first = [pool.submit(curated, t) for t in ("orders", *LOOKUP_KEYS)]
        rest = [pool.submit(curated, t) for t in TABLES if t not in ("orders", *looked_up_later, *LOOKUP_KEYS)]
        for done in [*first, *rest]:
            done.result()
    for table in looked_up_later:  # the largest, one after the other
        curated(table)
    repeated = {t: n for t, n in made["repeats"].items() if n["keys"]}
    if repeated and refuse_repeats:
        raise ValueError(f"repeated keys: {', '.join(f'{t} {n["keys"]}' for t, n in sorted(repeated.items()))}")
    made["rows"] = {t: made["rows"][t] for t in TABLES}
    if facts:
        _write_facts(spark, fresh, path, made)
    if summaries:
        _write_summaries(spark, fresh, path, made)
    return write_manifest(spark, root, version, made)


def _write_facts(spark: SparkSession, fresh: Warehouse, path: str, made: dict) -> None:
    joined = facts_of(fresh)
    write_facts(joined, path, made)
    whole = read_bucketed(spark, table_path(path, FACTS), made["schemas"][FACTS], "order_id", made["buckets"])
    write_grains(grains.all_grains(whole, fresh.params), path, made)


def write_facts(joined: DataFrame, path: str, made: dict) -> None:
    made["schemas"][FACTS] = ddl(joined)
    write_bucketed(joined, table_path(path, FACTS), "order_id", made["buckets"])


def write_grains(found: DataFrame, path: str, made: dict) -> None:
    """Measures by grain: a folder each, ranges of its keys inside."""
    made["schemas"][GRAINS] = ddl(found)
    write_files(found, table_path(path, GRAINS), ("grain", *grains.KEYS), ("grain",))


def _write_summaries(spark: SparkSession, fresh: Warehouse, path: str, made: dict) -> None:
    columns = ("order_id", "seller_id", "seller_state", "customer_state")
    if FACTS in made["schemas"]:  # dealt by order: the joins by order shuffle orders only
        items = read_bucketed(spark, table_path(path, FACTS), made["schemas"][FACTS], "order_id", made["buckets"])
        items = items.select(*columns)
    else:
        items = fresh.table("order_items", *columns)
    orders = fresh.table("orders", "order_id", "order_month", "is_late")
    orders = orders.groupBy("order_id", "order_month").agg(F.max("is_late").alias("late"))
    pairs = items.join(orders, "order_id")  # repeated pairs set the same bits
    numbers = table_path(path, "order_numbers")
    write_files(number_orders(pairs, "order_id", ("order_month", "seller_id", "customer_state")), numbers)
    numbered = pairs.join(read_files(spark, numbers, None, "order_id string, number bigint"), "order_id")
    bitmaps = order_bitmaps(numbered, BITMAP_KEYS)
    made["schemas"][BITMAPS] = ddl(bitmaps)
    write_files(bitmaps, table_path(path, BITMAPS), (*BITMAP_KEYS, "bucket"))
    storage.delete(spark, numbers)
    sketches = fresh.sketches()
    made["schemas"][SKETCHES] = ddl(sketches)
    write_files(sketches, table_path(path, SKETCHES), ("order_month", "component"))


def clean_lake(spark: SparkSession, lake: str, root: str) -> dict[str, str]:
    """Delete the lake versions that the published warehouse was made from, all or nothing.

    Nothing is deleted unless one version of the warehouse holds all tables and the facts. A
    version that an ingest brought meanwhile is not in its manifest and stays, and so do older
    ones whose files it goes on using. A delete that fails is only reported.
    """
    lake, root = lake.rstrip("/"), root.rstrip("/")
    version = current(spark, root)
    made = manifest(spark, root, version) if version else {"lake": {}, "schemas": {}}
    whole = FACTS in made["schemas"] and set(made["lake"]) == set(TABLES)
    outcome = {}
    for table in TABLES:
        path = table_path(lake, table)
        now, used = current(spark, path), made["lake"].get(table)
        shared = lakes.folders(spark, path, now) if now and now != used else set()
        if not whole:
            outcome[table] = "absent" if now is None else "kept: not published yet"
        elif not storage.exists(spark, f"{path}/{used}"):
            outcome[table] = "absent" if now is None else "kept: newer than the warehouse"
        elif used in shared:
            outcome[table] = "kept: shared with a newer load"
        else:
            try:
                old = lakes.folders(spark, path, used) - shared | {used}
                done = [storage.delete(spark, f"{path}/{v}") for v in sorted(old)]
                outcome[table] = "deleted" if any(done) else "not deleted"
            except Exception as error:  # a full lake must not fail a finished refresh
                outcome[table] = f"not deleted: {type(error).__name__}"
    return outcome
