"""Ingest: one CSV source per raw table into the lake."""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.schemas import TABLES, raw_schema
from parcelwatch.sources import lake as lakes
from parcelwatch.sources import storage
from parcelwatch.sources.csv_files import source_key, write_csv
from parcelwatch.sources.tables import current, new_version, publish, table_path

REPORT_SCHEMA = (
    "table string, status string, rows bigint, "
    "files_loaded int, files_unchanged int, files_removed int"
)


def ingest(
    spark: SparkSession, source: str, lake: str, required: Collection[str] = ()
) -> DataFrame:
    """Load `{source}/{table}.csv` (a file or a folder of files) into `{lake}/{table}`.

    An absent source is skipped unless it is `required`; any other failure stops the run. Files
    are loaded one by one: a file with the name, length and time it was loaded with before is not
    read again, the rows of a file that is gone go, and a table none of whose files changed keeps
    its version. So a repeated or resumed run never doubles rows, and a daily run reads what the
    day brought. Returns one row per table with its rows and what became of its files.
    """
    paths = {table: f"{source.rstrip('/')}/{table}.csv" for table in TABLES}
    found = {table for table, path in paths.items() if storage.exists(spark, path)}
    absent = [paths[table] for table in required if table not in found]
    if absent:
        raise FileNotFoundError(", ".join(absent))

    def load(table: str) -> tuple:
        if table not in found:
            return table, "skipped", None, None, None, None
        return table, *load_files(spark, paths[table], lake, table)

    with ThreadPoolExecutor(max_workers=4) as pool:
        report = list(pool.map(load, TABLES))
    return spark.createDataFrame(report, REPORT_SCHEMA)


def load_files(spark: SparkSession, source: str, lake: str, table: str) -> tuple:
    """Load what is new under `source`: status, rows, files loaded, unchanged and removed."""
    path = table_path(lake, table)
    there = storage.file_status(spark, source)
    if not there:
        raise ValueError(f"{source}: no files")
    now = current(spark, path)
    known = lakes.files_of(spark, path, now)
    same = {
        name: loaded
        for name, loaded in known.items()
        if name in there and there[name][1:] == (loaded.length, loaded.time)
    }
    fresh = sorted(set(there) - set(same))
    removed = len(set(known) - set(there))
    changed = (len(fresh), len(same), removed)
    if known and not fresh and not removed:
        return "unchanged", _rows(spark, path, now, table), *changed
    version = new_version()
    rows = write_csv(spark, [there[n][0] for n in fresh], table, f"{path}/{version}") if fresh else 0
    files = dict(same)
    for name in fresh:
        folder = f"{version}/{lakes.SOURCE}={source_key(name)}"
        has_rows = storage.exists(spark, f"{path}/{folder}")
        files[name] = lakes.Loaded(there[name][1], there[name][2], folder if has_rows else None)
    lakes.write_files_of(spark, path, version, files)
    publish(spark, path, version)
    return "loaded", _rows(spark, path, version, table) if same else rows, *changed


def _rows(spark: SparkSession, path: str, version: str, table: str) -> int:
    """Rows of a version, out of the footers of its files."""
    return lakes.read_parts(spark, path, version, raw_schema(table)).count()


def loaded_share(report: DataFrame) -> DataFrame:
    """How many of the tables were loaded."""
    loaded = F.count_if(F.col("status") != "skipped")
    return report.agg(loaded.alias("loaded"), F.count(F.lit(1)).alias("tables"))
