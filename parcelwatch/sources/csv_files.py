"""CSV files with a header, bound to the raw columns by name."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelwatch.functions.texts import normal_name, normalise_columns
from parcelwatch.schemas import RAW
from parcelwatch.sources import storage
from parcelwatch.sources.lake import SOURCE
from parcelwatch.sources.records import read_lines, read_records

# Cells that mean "missing", the defaults of a widely used CSV reader.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one raw table; columns outside the schema are kept as text.

    `path` is a file or a folder of files, each with a header of its own: columns are bound by
    name, whatever their order in a file. Any cell may hold line breaks, and any file is read by
    many tasks (see `records`). A column that only some files have is missing in the others.
    """
    files = storage.data_files(spark, path)
    if not files:
        raise ValueError(f"{path}: no files")
    return _bound(headers_of(spark, files, table), table, lambda head, some: _whole(spark, some))


def write_csv(spark: SparkSession, files: Sequence[str], table: str, path: str) -> int:
    """Write the rows of the files as Parquet, a folder `source_file=...` each; returns their number.

    One pass, if no cell holds a line break: that every line is a record is checked while the lines
    are written. If one is not, what was written goes and the files are read record by record.
    """
    heads = headers_of(spark, files, table)
    rows = _written_as_lines(spark, heads, table, path)
    if rows is None:
        storage.delete(spark, path)
        rows = _write(_bound(heads, table, lambda head, some: _whole(spark, some), source=True), path)
    return rows


def _written_as_lines(spark: SparkSession, heads: Mapping[str, list[str]], table: str, path: str) -> int | None:
    """The rows written with every line as a record; None if that is not what the lines are."""
    seen = {head: Observation() for head in heads}
    plain = _bound(heads, table, lambda head, some: read_lines(spark, some, head, seen[head]), source=True)
    try:
        rows = _write(plain, path)
    except (PySparkException, Py4JJavaError):  # a piece of a record that does not parse; if not, reading records says so
        return None
    found = {head: watch.get for head, watch in seen.items()}
    right = all(found[h]["opens"] == 0 and found[h]["heads"] == len(some) for h, some in heads.items())
    return rows if right else None


def _write(df: DataFrame, path: str) -> int:
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.partitionBy(SOURCE).parquet(path)
    return counted.get["rows"]


def source_key(name: str) -> str:
    """What the folder of a file's rows is named by; `name` as Spark spells it in paths."""
    return hashlib.md5(name.encode()).hexdigest()


def headers_of(spark: SparkSession, files: Sequence[str], table: str) -> dict[str, list[str]]:
    """The files by their first line. A file that lacks a column of the table is refused."""
    with ThreadPoolExecutor(max_workers=16) as pool:
        heads = list(pool.map(lambda file: storage.first_line(spark, file), files))
    by_head: dict[str, list[str]] = {}
    for head, file in zip(heads, files, strict=True):
        by_head.setdefault(head, []).append(file)
    for head, some in by_head.items():
        known = {normal_name(name) for name in _names(head)}
        missing = [c for c in RAW[table] if c not in known]
        if missing:
            raise ValueError(f"{some[0]}: no column {', '.join(missing)}")
    return by_head


def _names(head: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([head]), ()))


def _whole(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return read_records(spark, files).filter(~F.col("header"))


def _bound(
    heads: Mapping[str, list[str]],
    table: str,
    read: Callable[[str, list[str]], DataFrame],
    source: bool = False,
) -> DataFrame:
    """The records of all files as columns of the table, bound by the names in their headers."""
    parts = []
    by_names: dict[tuple[str, ...], list[DataFrame]] = {}
    for head, some in heads.items():
        by_names.setdefault(_names(head), []).append(read(head, some))
    for names, records in by_names.items():
        parts.append(_cells(reduce(DataFrame.unionByName, records), names, table, source))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _cells(records: DataFrame, names: tuple[str, ...], table: str, source: bool) -> DataFrame:
    schema = ", ".join(f"{_quoted(name)} string" for name in names)
    # breaks inside a cell arrive as LF
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    key = [F.md5(F.substring_index("file", "/", -1).cast("binary")).alias(SOURCE)] if source else []
    cells = records.select(F.from_csv(text, schema, OPTIONS).alias("cells"), *key)
    df = normalise_columns(cells.select("cells.*", *[SOURCE] * source))
    kept = [SOURCE] * source
    return df.select(*[_typed(name, RAW[table]) for name in df.columns if name not in kept], *kept)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _typed(name: str, types: Mapping[str, str]) -> Column:
    cell = F.when(~F.col(name).isin(*MISSING), F.col(name))
    return cell.cast(types.get(name, "string")).alias(name)
