"""File operations on whatever file system a path names (HDFS, object store, local)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly under `path`; none if it is absent."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(where)) if n[0] != "."]


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str = "") -> None:
    """A new file with `text`; an empty one appears in one step on any file system."""
    fs, where = _open(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def data_files(spark: SparkSession, path: str) -> list[str]:
    """`path` itself, or the files directly under it that are not hidden or empty."""
    fs, where = _open(spark, path)
    found = [s for s in fs.listStatus(where) if s.isFile() and s.getLen()]
    return sorted(
        s.getPath().toString() for s in found if s.getPath().getName()[0] not in "._" or s.getPath() == where
    )


def file_status(spark: SparkSession, path: str) -> dict[str, tuple[str, int, int]]:
    """Path, length and time of change of each data file of `path`, by its name as Spark spells it."""
    found = {}
    for file in data_files(spark, path):
        fs, where = _open(spark, file)
        status = fs.getFileStatus(where)
        name = str(status.getPath().toUri().toString()).rpartition("/")[2]
        found[name] = (file, status.getLen(), status.getModificationTime())
    return found


def first_line(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(where), "UTF-8"))
    try:
        return (reader.readLine() or "").removeprefix("\ufeff")
    finally:
        reader.close()
