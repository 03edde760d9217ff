"""E: evaluation roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import rollup as R
from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, table, view

_OUTCOMES = """
select event_id as trace_id,
       case when value < 20 then 'answer' when value < 60 then 'ambiguity' else 'rejection' end
           as expected_outcome,
       case event_type when 'error' then 'error' when 'signup' then 'rejected'
                       when 'purchase' then 'invalid_sql' else 'answer' end as run_kind,
       concat('raised ', event_type) as error
from events
"""


@query(
    "E01_outcome",
    f"""
select trace_id, 'expected_outcome' as name,
       case when run_kind = 'answer' then expected_outcome = 'answer'
            when expected_outcome = 'ambiguity' then run_kind = 'rejected'
            when expected_outcome = 'rejection' then run_kind in ('rejected', 'invalid_sql')
            else false end as passed,
       case when run_kind <> 'answer' then error when expected_outcome = 'answer' then 'Agent answered'
            else 'Expected rejection' end as message,
       run_kind <> 'answer' as final
from ({_OUTCOMES}) t
""",
)
def e01(spark, sf):
    return R.check_outcome(view(spark, sf, _OUTCOMES)).select(
        "trace_id", "name", "passed", "message", "final"
    )


@query(
    "E02_usage",
    """
with u as (select distinct l_orderkey, l_returnflag from lineitem),
     m as (select o_orderkey as case_id,
                  (select string_agg('flag_' || f, ', ' order by f) from (values ('A'), ('N')) v(f)
                   where not exists (select 1 from u where u.l_orderkey = o_orderkey and u.l_returnflag = f)) as lack,
                  exists (select 1 from u where u.l_orderkey = o_orderkey and u.l_returnflag = 'R') as bad
           from orders)
select case_id, 'required_models' as name, lack is null as passed,
       coalesce('missing: ' || lack, '') as message from m
union all
select case_id, 'forbidden_models', not bad, case when bad then 'forbidden: flag_R' else '' end from m
""",
)
def e02(spark, sf):
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.array(F.lit("flag_A"), F.lit("flag_N")).alias("required"),
        F.array(F.lit("flag_R")).alias("forbidden"),
    )
    usage = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("flag_"), "l_returnflag").alias("item")
    )
    return R.check_usage(cases, usage)


_CHECKS = """
select l_orderkey as trace_id, l_linenumber as ordinal,
       case when l_linenumber = 7 then 'correctness_eval:suite/case'
            else concat('check_', cast(l_linenumber as varchar(2))) end as name,
       l_returnflag <> 'R' as passed,
       case when l_linestatus = 'O' then '' else concat('late ', l_returnflag) end as message
from lineitem
"""


@query(
    "E03_trace",
    f"""
with n as (select trace_id, name, min(ordinal) as ordinal, bool_and(passed) as passed,
                  min(message) filter (where not passed) as message
           from ({_CHECKS}) t group by 1, 2)
select trace_id, bool_and(passed) as passed, count(*) filter (where not passed) as n_failed,
       coalesce(string_agg(name || ': ' || case when message = '' then 'failed' else message end, '; '
                           order by ordinal) filter (where not passed), '') as message,
       bool_and(passed) and count(*) filter (where name = 'correctness_eval:suite/case') > 0
           as correctness_verified
from n group by trace_id
""",
)
def e03(spark, sf):
    return R.rollup_trace(view(spark, sf, _CHECKS))


_CASE_CHECKS = """
select concat('agent_', cast(user_id % 20 as varchar(20))) as agent, cast(ts as date) as trial,
       event_type as case_name, value < 300 as passed
from events
"""


@query(
    "E04_case",
    f"""
select agent, cast(trial as varchar) as trial, case_name, bool_and(passed) as passed,
       count(*) filter (where not passed) as n_failed
from ({_CASE_CHECKS}) t group by 1, 2, 3
""",
)
def e04(spark, sf):
    checks = view(spark, sf, _CASE_CHECKS).withColumn("trial", F.col("trial").cast("string"))
    return R.rollup_case(checks, "agent", "trial", "case_name")


_SUITE_ORACLE = f"""
select agent, trial, bool_and(passed) as passed, count(*) as n_cases,
       count(*) filter (where passed) as n_passed
from (select agent, trial, case_name, bool_and(passed) as passed from ({_CASE_CHECKS}) t group by 1, 2, 3) c
group by 1, 2
"""


@query("E05_suite", f"select cast(trial as varchar) as trial, agent, passed, n_cases, n_passed from ({_SUITE_ORACLE}) s")
def e05(spark, sf):
    return R.rollup_suite(e04(spark, sf), "agent", "trial")


@query(
    "E06_pass_rate",
    f"""
select agent, count(*) as n_trials, count(*) filter (where passed) as n_passed,
       avg(case when passed then 1.0 else 0.0 end) as pass_rate
from ({_SUITE_ORACLE}) s group by agent
""",
)
def e06(spark, sf):
    return R.pass_rate(e05(spark, sf), "agent")


@query(
    "E06_trials",
    """
select c_custkey as suite, trials, cast(unnest(range(1, trials + 1)) as integer) as trial
from (select c_custkey, case when c_mktsegment = 'BUILDING' then 3 else 1 end as trials from customer) t
""",
)
def e06_trials(spark, sf):
    suites = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("suite"),
        F.when(F.col("c_mktsegment") == "BUILDING", 3).otherwise(1).alias("trials"),
    )
    return R.expand_trials(suites)


@query(
    "E07_filter",
    f"select trace_id, agent, case_name from ({fx.RUNS}) t where agent = 'agent_7' and case_name = 'click'",
)
def e07(spark, sf):
    runs = view(spark, sf, fx.RUNS).select("trace_id", "agent", "case_name")
    return R.filter_cases(runs, "agent_7", "click")


@query(
    "E08_coverage",
    """
select n_name as agent, count(c_custkey) as n_cases, count(c_custkey) > 0 as covered
from nation left join customer
  on c_nationkey = n_nationkey and c_mktsegment <> 'BUILDING' and c_acctbal > 9900
group by n_name
""",
)
def e08(spark, sf):
    agents = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("agent"))
    cases = (
        table(spark, sf, "customer")
        .join(agents, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "agent",
            F.when(F.col("c_mktsegment") == "BUILDING", "rejection").otherwise("answer").alias("expected_outcome"),
            (F.col("c_acctbal") > 9900).alias("verifies_result"),
        )
    )
    return R.coverage(agents, cases)


def _live(spark, sf):
    runs = view(spark, sf, fx.QUESTIONS).select(
        F.concat_ws("/", "conv_id", "turn").alias("trace_id"),
        F.lit("helper").alias("agent"),
        "question",
        (F.length("question") > 60).alias("passed"),
    )
    cases = view(spark, sf, fx.APPROVED).select(
        F.lit("helper").alias("agent"),
        "question",
        F.concat(F.lit("suite-"), "case_turn").alias("suite"),
        F.concat(F.lit("digest-"), "case_turn").alias("suite_digest"),
        F.concat_ws("/", "case_id", "case_turn").alias("case_name"),
        F.lit("answer").alias("expected_outcome"),
        F.lit(True).alias("verifies_result"),
    )
    return runs, cases


_ASKED = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', ' ', 'g'))"
_MATCHES = f"""
select concat(q.conv_id, '/', q.turn) as trace_id, concat(c.case_id, '/', c.case_turn) as case_name,
       concat('suite-', c.case_turn) as suite, concat('digest-', c.case_turn) as suite_digest,
       length(q.question) > 60 as passed
from ({fx.QUESTIONS}) q join ({fx.APPROVED}) c
  on {_ASKED.format('q.question')} = {_ASKED.format('c.question')}
"""


@query("E09_match_live", f"select trace_id, case_name, suite, suite_digest, passed from ({_MATCHES}) m")
def e09_match(spark, sf):
    return R.match_live(*_live(spark, sf)).select("trace_id", "case_name", "suite", "suite_digest", "passed")


@query(
    "E09_verify_live",
    f"""
select r.trace_id, coalesce(m.n, 0) as n_matched,
       case when m.ok and r.passed then 'VERIFIED' else 'UNVERIFIED' end as status, m.suite_digest,
       case when m.n is null then 'No approved eval case exactly matches this question'
            when not m.ok then 'An approved eval case failed'
            when not r.passed then 'A check of the run failed' else 'Approved eval matched' end as message
from (select concat(conv_id, '/', turn) as trace_id, length(question) > 60 as passed
      from ({fx.QUESTIONS}) q) r
left join (select trace_id, count(*) as n, bool_and(case_name not like '%/4') as ok,
                  max(suite_digest) as suite_digest
           from ({_MATCHES}) x group by 1) m on r.trace_id = m.trace_id
""",
)
def e09_verify(spark, sf):
    runs, cases = _live(spark, sf)
    matches = R.match_live(runs, cases).withColumn("case_passed", ~F.col("case_name").endswith("/4"))
    return R.verify_live(runs, matches)


@query(
    "E10_starter_cases",
    """
select 'b' as suite, concat('case-', item_id) as case_name, text as question, 'answer' as expected_outcome,
       'unordered' as comparison, item_id as row_count from benchmark
union all select 'b', concat('case-', item_id, '-paraphrase'), concat('Please answer this another way: ', text), 'answer',
                 'unordered', item_id from benchmark
union all select 'b', concat('case-', item_id, '-ambiguity'), 'Revenue?', 'ambiguity', null, null from benchmark
union all select 'b', concat('case-', item_id, '-out-of-scope'),
                 'Show data from a resource outside this agent''s dbt scope.', 'rejection', null, null from benchmark
""",
)
def e10(spark, sf):
    cases = table(spark, sf, "benchmark").select(
        F.lit("b").alias("suite"), F.concat(F.lit("case-"), "item_id").alias("case_name"),
        F.col("text").alias("question"), F.lit("unordered").alias("comparison"), F.col("item_id").alias("row_count"),
    )
    return R.expand_cases(cases)


_NEW_CASES = """
select s_nationkey as suite,
       case when s_acctbal > 8000 then replace(s_name, 'Supplier', 'Customer') else s_name end as case_name
from supplier
"""


@query(
    "E11_merge_cases",
    f"""
with old as (select c_nationkey as suite, c_name as case_name from customer),
     new as ({_NEW_CASES}),
     blocked as (select distinct new.suite from new join old using (suite, case_name))
select suite, case_name from old
union all select suite, case_name from new where suite not in (select suite from blocked)
""",
)
def e11(spark, sf):
    old = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("suite"), F.col("c_name").alias("case_name")
    )
    return R.merge_cases(old, view(spark, sf, _NEW_CASES))


@query(
    "E12_case_slug",
    "select doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 60) as case_name from documents",
)
def e12(spark, sf):
    return R.name_cases(table(spark, sf, "documents"), "text").select("doc_id", "case_name")
