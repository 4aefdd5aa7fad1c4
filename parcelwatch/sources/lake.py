"""Lake tables that are loaded file by file: what a version is made of, and reading it.

A version of a lake table lists its source files with the length and time they were loaded with,
and the folder that holds the rows of each. A folder may lie in an older version: a source file
that has not changed since is not read again. Versions without a list are one folder.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from parcelwatch.sources import storage

FILES = "_files.json"
SOURCE = "source_file"


@dataclass(frozen=True)
class Loaded:
    """A source file as it was loaded; `folder` is missing if it had no rows."""

    length: int
    time: int
    folder: str | None


def files_of(spark: SparkSession, path: str, version: str | None) -> dict[str, Loaded]:
    """The source files of a version; none if it has no list."""
    if version is None or not storage.exists(spark, f"{path}/{version}/{FILES}"):
        return {}
    listed = json.loads(storage.read_text(spark, f"{path}/{version}/{FILES}"))
    return {name: Loaded(**one) for name, one in listed.items()}


def write_files_of(spark: SparkSession, path: str, version: str, files: Mapping[str, Loaded]) -> None:
    text = json.dumps({name: asdict(one) for name, one in sorted(files.items())})
    storage.write_text(spark, f"{path}/{version}/{FILES}", text)


def parts(spark: SparkSession, path: str, version: str) -> set[str]:
    """The folders, relative to the table, that hold the rows of a version."""
    listed = files_of(spark, path, version)
    return {f.folder for f in listed.values() if f.folder} if listed else {version}


def folders(spark: SparkSession, path: str, version: str) -> set[str]:
    """The version folders that hold rows of a version."""
    return {part.partition("/")[0] for part in parts(spark, path, version)}


def read_parts(
    spark: SparkSession, path: str, version: str, schema: str, only: set[str] | None = None
) -> DataFrame:
    """The rows of a version, or of some of its folders.

    A version folder whose parts are all wanted is read as one, so that a table that only grows is
    as many paths as it has versions.
    """
    wanted = parts(spark, path, version) if only is None else only
    paths = set(wanted)
    for folder in {part.partition("/")[0] for part in wanted}:
        inside = {f"{folder}/{n}" for n in storage.names(spark, f"{path}/{folder}") if n.startswith(f"{SOURCE}=")}
        if inside and inside <= wanted:
            paths = paths - inside | {folder}
    if not paths:
        return spark.createDataFrame([], schema)
    # folders of several versions side by side are no partitions of one table
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return reader.parquet(*[f"{path}/{p}" for p in sorted(paths)])
