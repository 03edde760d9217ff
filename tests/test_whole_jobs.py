"""Queries whose job must not shrink: every vertex is walked from, every answer with cited text is judged."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def sql(text):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return {r[0] for r in con.sql(text).fetchall()}


def test_upstream_starts_at_every_vertex(spark):
    starts = {r.start for r in entry.queries()["B03_upstream"](spark, SF).select("start").distinct().collect()}
    assert starts >= sql("select concat('order.', o_orderkey) from orders join customer on c_custkey = o_custkey") | sql("select concat('customer.', c_custkey) from customer")


def test_downstream_starts_at_every_vertex(spark):
    starts = {r.start for r in entry.queries()["B04_downstream"](spark, SF).select("start").distinct().collect()}
    assert starts >= sql("select concat('customer.', o_custkey) from orders join customer on c_custkey = o_custkey where o_orderpriority <> '1-URGENT'")
    assert starts >= sql("select concat('nation.', c_nationkey) from customer where c_acctbal >= 0")


def test_text_support_judges_answers_of_ten_orders_too(spark):
    judged = {r.trace_id for r in entry.queries()["F07_text_support"](spark, SF).collect()}
    ten = sql("select o_custkey from orders group by 1 having count(*) = 10")
    assert ten and judged >= ten


def test_runs_resolve_their_own_queries_as_the_whole_log_does(spark):
    from plumbline.operators import audit as A
    from plumbline.plans import audits as AU
    from plumbline.plans.evaluation import _RUN_QUERIES
    from plumbline.plans.registry import view

    own = view(spark, SF, _RUN_QUERIES).select("query_id")
    of_runs, whole = AU.resolved_log(spark, SF, own), AU.resolved_log(spark, SF)
    wanted = {r.query_id for r in own.collect()}
    for few, every in zip(of_runs, whole):
        got, kept = few.collect(), [r for r in every.collect() if r.query_id in wanted]
        assert got and {r.query_id for r in got} <= wanted
        assert sorted(map(str, got)) == sorted(map(str, kept))
    assert A.used_resources(of_runs[1]).count()


def test_suites_count_what_the_evaluation_passes(spark):
    """Suites ask which cases passed, not why others failed: the differences of failed comparisons are not read for them."""
    from plumbline.plans.evaluation import _verdicts

    told, brief = ({r.trace_id: (r.passed, r.n_failed) for r in _verdicts(spark, SF, explain=explain)[0].collect()} for explain in (True, False))
    assert told == brief and len({passed for passed, _ in told.values()}) == 2
