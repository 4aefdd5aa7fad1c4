"""Session settings the jobs rely on, and the shared folder of the cluster."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession

# Runtime settings only: each can be applied to a session somebody else built.
# Sizing (executors, shuffle partitions, memory) is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over tasks, also where that costs one more shuffle
    # before the aggregation above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A hot leading sort key is split over files when a table is written.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A task that writes a few folders keeps their files open instead of sorting its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Without it the files of a shuffle stay until the driver's garbage is collected, which may be
# after the last table is written. A frame that is collected twice makes its shuffles again, so
# this is set around writes, whose plans run once, and not for the session.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock, _writers, _before = Lock(), Counter(), {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes the files of its shuffles as soon as it is done.

    Writers of several threads may be inside; the last one to leave restores the setting.
    """
    with _lock:
        if not _writers[spark]:
            _before[spark] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        _writers[spark] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[spark] -= 1
            if not _writers[spark]:
                del _writers[spark]
                before = _before.pop(spark)
                spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def build_session(app_name: str = "parcelwatch", **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` uses `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Where it is unset, a local session gets one temporary folder for its life; a cluster is
    refused, because a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="parcelwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
