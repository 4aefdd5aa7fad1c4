"""Run registered queries against their oracles: `python -m checks.compare [sf_dir] [key ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.cases import CASES, SQL, run_case

SHARED = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in SHARED:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    """Rows with columns in name order, sorted; doubles at 9 significant decimals."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else round(value, 9) + 0.0
        return value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(spark: SparkSession, key: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    df = run_case(key)(spark, sf_dir)
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con: duckdb.DuckDBPyConnection, key: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(SQL[key])
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for key in argv[1:] or CASES:
        start = time.time()
        try:
            got = spark_rows(spark, key, sf_dir)
            taken = time.time() - start
            if key not in SQL:
                print(f"rows {key} {len(got[1])} {taken:.2f}s")
                continue
            want = oracle_rows(con, key)
        except Exception as error:
            print(f"FAIL {key}: {str(error)[:1500]}")
            bad += 1
            continue
        same = got == want
        bad += not same
        print(f"{'ok' if same else 'DIFF'} {key} {len(got[1])} {taken:.2f}s")
        if not same:
            print("  columns", got[0] == want[0], "rows", len(got[1]), len(want[1]))
            odd = [p for p in zip(got[1], want[1], strict=False) if p[0] != p[1]]
            print("  first", odd[:2])
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
