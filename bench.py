"""Time the pipeline: ingest, refresh and the fourteen reports on the published tables.

Prints one JSON line. `BENCH_SF_DIR` names the test tables, `BENCH_CPUS` the local cores.
The CSV input is derived from the test tables first; that step is not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid

from pyspark.sql import SparkSession

from checks.cases import inputs
from parcelwatch.plans.curated import Warehouse, lake_tables, refresh
from parcelwatch.plans.ingest import ingest
from parcelwatch.plans.reports import REPORTS
from parcelwatch.session import configure, shared_dir

RUNS = 3


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        # files of a few MB, so that a small table still gives every core something to read
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    root = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    source, lake, warehouse = f"{root}/source", f"{root}/lake", f"{root}/warehouse"

    for table, df in inputs(spark, sf_dir).raw.items():
        df.repartition(int(cpus)).write.csv(f"{source}/{table}.csv", header=True, escape='"')

    stages = {  # a lake of its own for each run: an ingest does not read again what it has loaded
        "ingest": lambda run: ingest(spark, source, f"{lake}-{run}"),
        "refresh": lambda run: refresh(spark, lake_tables(spark, f"{lake}-0"), warehouse),
    }
    times = {}
    for name, stage in stages.items():
        times[name] = statistics.median(seconds(lambda run=run, stage=stage: stage(run)) for run in range(RUNS))

    tables = Warehouse.published(spark, warehouse)
    for name, report in REPORTS.items():
        run = [seconds(lambda report=report: report(tables).collect()) for _ in range(RUNS + 1)]
        times[f"report_{name}"] = statistics.median(run[1:])

    print(
        json.dumps(
            {
                "metric": "ingest, refresh and 14 reports, warm medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
