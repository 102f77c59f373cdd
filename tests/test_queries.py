"""Registered queries against their SQL, and what their plans must not contain."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle
from hitlytics.plans import oracle
from hitlytics.plans.queries import QUERIES

from helpers import plan_of


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(oracle.statements()) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    verdict = check_oracle.compare(spark, con, name, sf_dir)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_ingest", "upkeep", "ingest_batches", "rerun_batches"}))
def test_plans_stay_on_the_jvm_without_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython",
                     "MapInPandas", "MapInArrow"):
        assert unwanted not in plan
    # A window without keys would put all rows into one task.
    for line in plan.splitlines():
        if "+- Window [" in line:
            assert not line.rstrip().endswith("specifiedwindowframe")
            assert "Exchange SinglePartition" not in plan.split(line, 1)[1].split("Exchange", 1)[-1][:16]


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["total_hits"] > 0
