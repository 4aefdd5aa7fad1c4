"""The daily job: `spark-submit -m parcelwatch.job SOURCE LAKE WAREHOUSE [--keep N] [--changed]`.

Runs ingest, refresh and clean-up in that order; a stage that fails stops the job and leaves
what the stages before it published.
"""

from __future__ import annotations

import argparse

from parcelwatch.plans.curated import clean_lake, lake_tables, refresh, versions_read
from parcelwatch.plans.delta import refresh_changed
from parcelwatch.plans.ingest import ingest
from parcelwatch.session import build_session
from parcelwatch.sources.tables import expire


def main(argv: list[str] | None = None) -> dict[str, str]:
    parser = argparse.ArgumentParser(prog="parcelwatch.job")
    parser.add_argument("source")
    parser.add_argument("lake")
    parser.add_argument("warehouse")
    parser.add_argument("--keep", type=int, default=1, help="old warehouse versions to keep")
    parser.add_argument(
        "--changed", action="store_true", help="refresh by difference; the lake stays for the next one"
    )
    given = parser.parse_args(argv)
    spark = build_session("parcelwatch-job")
    ingest(spark, given.source, given.lake).show(truncate=False)
    make = refresh_changed if given.changed else refresh
    make(spark, lake_tables(spark, given.lake), given.warehouse).show(truncate=False)
    cleaned = {} if given.changed else clean_lake(spark, given.lake, given.warehouse)
    expire(spark, given.warehouse, keep=versions_read(spark, given.warehouse), spare=given.keep)
    for table, outcome in cleaned.items():
        print(f"{table}: {outcome}")
    return cleaned


if __name__ == "__main__":
    main()
