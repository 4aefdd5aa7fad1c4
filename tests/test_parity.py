"""Every registered query equals its oracle on the shared tables."""

from __future__ import annotations

import pytest
from helpers import SF

import __spark_entry__
from checks.cases import CASES, SQL
from checks.compare import connect, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", list(SQL))
def test_query_equals_oracle(spark, duck, key):
    columns, rows = spark_rows(spark, key, SF)
    assert (columns, rows) == oracle_rows(duck, key)
    assert rows


def test_every_case_has_an_oracle():
    assert set(CASES) == set(SQL)


def test_sketches_are_close_to_exact(spark):
    from checks.cases import inputs
    from parcelwatch.plans import reports

    wh = inputs(spark, SF).wh
    exact = {r[0]: r for r in spark_rows(spark, "report_stage_statistics", SF)[1]}
    for row in reports.approximate_stage_statistics(wh).collect():
        for got, want in zip((row[k] for k in sorted(row.asDict())), exact[row["komponen"]], strict=True):
            assert got == want or abs(got - want) <= 0.2
    for row in reports.merged_stage_quantiles(wh).collect():
        want = exact[row["komponen"]]
        assert abs(row["median_hari"] - want[2]) <= 0.5 and abs(row["p90_hari"] - want[3]) <= 0.5


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
