"""The registered queries against their SQL at the smallest scale, and the shape of their plans."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare, connect
from workload import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

# Each runs jobs of its own ahead of the plan that it returns, which is a scan of a lake.
LAKE = {
    "load_run", "load_rejects", "load_run_rows", "stream_ingest", "stream_prices", "options_upsert", "scan_quotes",
    "lake_expired", "upsert_extras", "lake_schema", "purge_options", "prices_merge", "prices_overwrite", "lake_status",
    "symbol_file_rows", "symbol_file_status",
}


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name).startswith("equal")


@pytest.mark.parametrize("name", ["prices_overwrite", "purge_options", "stream_prices"])
def test_reads_of_a_lake_move_no_rows(spark, name):
    plan = plan_of(spark, name)
    assert "FileScan parquet" in plan and "Exchange" not in plan and "Join" not in plan


def test_loads_of_the_same_days_move_once_when_read(spark):
    plan = plan_of(spark, "options_upsert")
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "WindowGroupLimit" in plan


def plan_of(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LAKE))
def test_no_python_and_no_products(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin|ArrowEval", plan)
    assert "SinglePartition" not in plan or name in {"load_verdict"}


def test_scans_read_only_what_a_check_needs(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "strikes_per_day"))
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"l_partkey", "l_quantity", "l_returnflag", "l_shipdate"}


def test_date_range_is_pushed_to_the_scan(spark):
    plan = plan_of(spark, "date_range")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate", plan)


def test_report_reads_quotes_twice_and_prices_once(spark):
    plan = plan_of(spark, "quality_report")
    assert plan.count("FileScan parquet") == 3


def test_plans_do_not_read_a_table_twice_for_one_answer(spark):
    assert plan_of(spark, "resume_plan").count("FileScan parquet") == 2
    # Resume dates, day counts and strikes of the quotes, and the closes.
    assert plan_of(spark, "split_windows").count("FileScan parquet") == 4


def test_json_is_not_parsed_again_by_a_derived_filter(spark):
    for name in ("ingest_compact", "ingest_standard", "ingest_envelope"):
        assert not re.search(r"Filter .*from_json", plan_of(spark, name))
