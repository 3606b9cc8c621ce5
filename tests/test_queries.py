"""Every registered query against its check SQL, plus the driver contract and plan shapes."""

import os
import re
import subprocess
import sys

import pytest
from compare import check_engine, compare

import __spark_entry__ as entry
from civiclake.plans.registry import ORACLES, QUERIES
from civiclake.sources.domain import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
entry.queries()


@pytest.fixture(scope="module")
def engine():
    return check_engine(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_check_sql(spark, engine, name):
    assert compare(spark, engine, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_filters_keep_and_lose_rows(spark):
    for sf in ("0.001", "0.01"):
        path = os.path.join(os.path.dirname(SF.rstrip("/")), f"sf{sf}")
        some = QUERIES["ct_filters"](spark, path).count()
        assert 0 < some < table(spark, path, "accounts").count()


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() > 0


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["ct_arrears_bands"](spark, SF))
    assert "ReadSchema: struct<c_acctbal:double>" in plan
    plan = plan_of(QUERIES["ct_distinct_awards"](spark, SF))
    assert re.search(r"PushedFilters: \[.*o_orderstatus", plan) or "o_orderstatus" in plan


def test_increment_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["rep_incremental"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_small_dimensions_are_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan_of(QUERIES["ct_collection_summary"](spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(QUERIES["ct_collection_summary"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_row_is_picked_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["ct_dedupe_latest"](spark, SF))


def test_domain_tables_keep_every_row(spark):
    for name, source in {"accounts": "customer", "properties": "part", "repairs": "lineitem", "referrals": "events"}.items():
        assert table(spark, SF, name).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
