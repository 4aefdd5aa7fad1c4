"""Versioned Parquet tables: written aside, published by an empty marker file.

A write goes to a version folder of its own and becomes current when a marker that names it
appears among the table's markers; the latest marker counts. Nothing is renamed or overwritten
and readers change nothing: a reader looks the version up once and keeps reading it, a failed
write leaves the old version current, and of two writers the one that publishes last wins as a
whole. Old versions stay until they are expired.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from parcelwatch.session import shuffles_dropped
from parcelwatch.sources import storage

MARKERS = "_published"
# Of written files; a third smaller than those of Spark's default.
COMPRESSION = "zstd"


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def new_version() -> str:
    """A folder name no other write has; names sort by time."""
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def current(spark: SparkSession, path: str) -> str | None:
    """The published version under `path`; none if nothing is published or it was deleted."""
    latest = max(storage.names(spark, f"{path}/{MARKERS}"), default=None)
    if latest is None:
        return None
    version = latest.partition("_")[2]
    return version if storage.exists(spark, f"{path}/{version}") else None


def publish(spark: SparkSession, path: str, version: str) -> None:
    storage.write_text(spark, f"{path}/{MARKERS}/{time.time_ns():020d}_{version}")


def expire(spark: SparkSession, path: str, keep: Collection[str] = (), spare: int = 1) -> list[str]:
    """Delete versions older than the current one, but for `keep` and the `spare` newest of them.

    Versions newer than the current one may still be being written and stay.
    """
    now = current(spark, path)
    if now is None:
        return []
    old = sorted(v for v in storage.names(spark, path) if v.startswith("v") and v < now)
    gone = [v for v in old[: len(old) - spare if spare else None] if v not in keep]
    for marker in storage.names(spark, f"{path}/{MARKERS}"):
        if marker.partition("_")[2] in gone:
            storage.delete(spark, f"{path}/{MARKERS}/{marker}")
    for version in gone:
        storage.delete(spark, f"{path}/{version}")
    return gone


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """The files under a path, or several, or some of their columns. A `schema` saves inferring one."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    columns: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """The current version of the table, or some of its columns."""
    path = table_path(root, table)
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path}: nothing published")
    return read_files(spark, f"{path}/{version}", columns, schema)


def write_files(
    df: DataFrame,
    path: str,
    sort_key: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    bloom: Sequence[str] = (),
    counted: Observation | None = None,
    made_of: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """The rows of `df` as Parquet files under `path`, ordered by the whole sort key.

    Ranges over the whole key hardly overlap, so statistics skip whole files, and a hot leading
    key is cut into several files by the rest of the key. A lookup by a column of `bloom`, which
    the order of rows does not help, skips row groups whose Bloom filter rules the value out; the
    filters take the size that the number of values asks for. The shuffles' files go with the
    write. `counted` gets `rows`. `made_of` turns
    the ordered rows into those that are written, several of one if need be, and keeps their order.
    """
    if sort_key:
        df = df.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key)
    if made_of is not None:
        df = made_of(df)
    if counted is not None:  # after the ranges are made: that step reads the rows once more
        df = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    writer = df.write.mode("errorifexists").option("compression", COMPRESSION)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if bloom:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)


def layout(df: DataFrame, sort_key: Sequence[str]) -> DataFrame:
    """A row per file of a table: its rows, lowest and highest key, and whether files overlap.

    A file overlaps if its lowest key is below the highest one of the files that begin before it.
    Only bounds of files are compared, of which there is a row a file.
    """
    key = F.struct(*sort_key)
    files = df.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    before = Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = F.coalesce(F.col("low") < F.max("high").over(before), F.lit(False))
    return files.withColumn("overlaps", overlaps)


def write_table(
    df: DataFrame,
    root: str,
    table: str,
    sort_key: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> str:
    """Publish the rows of `df` as the new version of the table; returns its folder."""
    spark, path, version = df.sparkSession, table_path(root, table), new_version()
    write_files(df, f"{path}/{version}", sort_key, partition_by)
    publish(spark, path, version)
    return f"{path}/{version}"
