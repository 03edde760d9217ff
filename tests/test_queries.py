"""Registered queries: entry point, registry, a sample against the SQL twins, and plan shape."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

from plumbline.plans.registry import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ("E00_evaluate", "D04_ordered", "D06_unordered", "F05_number_support", "B03_upstream", "C13_verdict", "E09_verify_live",
          "A03_resources", "Q08_rollup", "S03_pass_rate_windows", "B06_relations", "C01_verdicts", "D07_unordered_columns", "Q04_overlapping_spells")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry_and_registry(spark):
    assert set(entry.entry(spark).columns) == {"trace_id", "passed", "n_failed", "message"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_twin(spark, con, name):
    problem, _ = compare(spark, con, name, SF)
    assert problem is None


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["Q01_scan_filter_case"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in text
    assert "l_shipdate" not in text.split("ReadSchema:")[1].splitlines()[0]


def test_exact_comparison_reads_keys_only_and_stays_in_the_jvm(spark):
    text = plan(entry.queries()["D06_unordered"](spark, SF))
    assert "Python" not in text and "Window" not in text and "Join" not in text
    assert "partial_sum" in text
