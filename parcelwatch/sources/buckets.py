"""Bucketed Parquet tables: rows dealt to files by a hash of their key, as the catalog knows.

Joins and groupings by the key read a bucket a task and shuffle nothing. Spark learns of buckets
from its catalog only, so a table is an external one there, under a name made from its path: the
files stay where they are written, any session can name them again, and forgetting the name
deletes nothing. The number of buckets is the number of tasks that read the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from parcelwatch.session import shuffles_dropped
from parcelwatch.sources.tables import COMPRESSION


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _name(path: str) -> str:
    return f"parcelwatch_{hashlib.md5(path.encode()).hexdigest()}"


def default_buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions: a bucket is what a task of the refresh held."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """The rows of `df` as a new table under `path`, a file a bucket, each sorted by the key.

    Where `df` comes out of a join on the key with as many partitions, nothing is shuffled again.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    with shuffles_dropped(df.sparkSession):
        writer.option("compression", COMPRESSION).option("path", path).saveAsTable(_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table under `path`, named in the catalog of this session if it is not yet."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        quoted = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{quoted}'"
        )
    return spark.table(name)


def forget(spark: SparkSession, path: str) -> None:
    """Drop the name of the table under `path`; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
