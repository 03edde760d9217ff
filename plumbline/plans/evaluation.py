"""E00: runs against cases with every comparison, every check, and settings that cannot be used."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import claims as V
from plumbline.operators import evaluation as E
from plumbline.operators.cells import to_rows
from plumbline.plans import audits as AU
from plumbline.plans import claim_checks as CC
from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, view
from plumbline.session import cut

_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderstatus"]
_MODES = ("ordered", "ordered_values", "unordered", "keyed", "scalar", "sideways", "keyed", "ordered")

# One run per customer; the case of a run has the customer's number. Modes go by the number modulo 8.
_RUNS = """
select distinct o_custkey as trace_id, o_custkey as case_id, o_custkey % 20 as suite, o_custkey % 3 + 1 as trial,
       case o_custkey % 11 when 0 then 'rejected' when 1 then 'invalid_sql' else 'answer' end as run_kind,
       case o_custkey % 11 when 0 then 'Ambiguous' when 1 then 'Bad query' end as error
from orders
"""
# The SQL of a run is the customer's first query of the log. A case asks for the resource of its smallest part and forbids that of the
# largest one, if the part itself is large.
_RUN_QUERIES = "select o_custkey as trace_id, min(o_orderkey) as query_id from orders group by o_custkey"
_UID = "concat('model.', lower({p}.p_type), '.part_', cast({p}.p_partkey as varchar(20)))"
_MODELS = f"""
select trace_id, {_UID.format(p='lo')} as required_model, case when hi.p_size > 25 then {_UID.format(p='hi')} end as forbidden_model
from (select trace_id, min(l_partkey) as low, max(l_partkey) as high from ({_RUN_QUERIES}) q join lineitem on l_orderkey = query_id group by trace_id) x
join part lo on lo.p_partkey = low join part hi on hi.p_partkey = high
"""


def _cases(runs):
    k = F.col("case_id")

    def when(rule, yes, no=None):
        return F.when(rule, yes).otherwise(no)

    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    mode = F.element_at(names(*_MODES), (k % 8 + 1).cast("int"))
    return runs.where(k % 101 != 0).select(
        "case_id",
        when(k % 13 == 0, F.lit("ambiguity"), when(k % 13 == 1, F.lit("rejection"), F.lit("answer"))).alias("expected_outcome"),
        F.array_compact(F.array("required_model")).alias("required_models"),
        F.array_compact(F.array("forbidden_model")).alias("forbidden_models"),
        names("id").alias("required_columns"),
        names("SIZE").alias("forbidden_columns"),
        (k % 10 != 0).alias("verifies_result"),
        mode.alias("mode"),
        when(k % 8 == 7, F.lit(-1.0), when(k % 8 == 2, F.lit(0.0), F.lit(0.01))).alias("tolerance"),
        (k % 8 == 0).alias("allow_extra"),
        when(k % 8 == 3, names("o_orderkey")).alias("keys"),
        when(k % 8 == 4, F.struct(F.lit("num").alias("kind"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("str"))).alias("value"),
        when(k % 4 == 0, F.lit(10)).alias("row_count"),
        when(k % 12 == 0, names("o_orderkey", "o_totalprice"), when(k % 6 == 0, names(*_COLUMNS))).alias("columns"),
    )


def _usage(spark, sf):
    """What the queries of the runs used, as the audit resolves them; those of no run need not be resolved."""
    own = cut(view(spark, sf, _RUN_QUERIES))
    _, resolved, columns = AU.resolved_log(spark, sf, own.select("query_id"))
    models = A.used_resources(resolved).join(own, "query_id").select("trace_id", F.lit("models").alias("subject"), F.col("unique_id").alias("item"))
    names = A.used_columns(columns).join(own, "query_id").select("trace_id", F.lit("columns").alias("subject"), F.col("name").alias("item"))
    return models.unionByName(names)


def _claims(spark, sf):
    """Whether each answer's claims hold, as the claim check finds."""
    checks = V.verify_claims(*CC.answer_tables(spark, sf)).where("name = 'claims_supported'")
    return checks.select("trace_id", F.col("passed").alias("claims_passed"), F.col("message").alias("claims_message"))


def _verdicts(spark, sf, explain=True):
    runs = cut(view(spark, sf, _RUNS).join(_claims(spark, sf), "trace_id", "left").join(view(spark, sf, _MODELS), "trace_id", "left"))
    sides = [to_rows(view(spark, sf, sql), "cmp_id", order_by=fx.ORDER_POSITION, columns=_COLUMNS) for sql in (fx.ACTUAL_ROWS, fx.EXPECTED_ROWS)]
    return E.case_verdicts(E.evaluate(runs, _cases(runs), _usage(spark, sf), *sides, explain=explain)), runs


_PRICE = "case when {p} = floor({p}) then cast(cast({p} as bigint) as varchar) else cast({p} as varchar) end"
_ROW = "concat('o_orderkey=', {t}.o_orderkey, ', o_totalprice=', " + _PRICE + ", ', o_orderstatus=', {t}.o_orderstatus)"
# Pairs of rows by position; 'off' tells those that differ under the mode of their case.
_PAIRS = f"""
select a.cmp_id as k, a.row_idx, a.o_orderkey, {_ROW.format(t='e', p='e.o_totalprice')} as wanted, {_ROW.format(t='a', p='a.o_totalprice')} as got,
       a.o_orderkey <> e.o_orderkey or abs(a.o_totalprice - e.o_totalprice) > case when a.cmp_id % 8 = 2 then 0 else 0.01 end as off
from ({fx.ACTUAL}) a join ({fx.EXPECTED}) e on a.cmp_id = e.cmp_id and a.row_idx = e.row_idx
"""

_ORACLE = f"""
with runs as ({_RUNS}), o as (
  select o_custkey as k, count(*) as n, count(*) filter (where o_totalprice >= 2500) as m,
         count(*) filter (where o_totalprice > 495000) as bad,
         count(*) filter (where o_totalprice between 2500 and 495000 and o_orderpriority = '5-LOW') as small, min(o_orderkey) as only_key
  from orders group by o_custkey
), used as (
  select q.trace_id as k, list(distinct unique_id) as models from ({AU.USED_SQL}) u join ({_RUN_QUERIES}) q using (query_id) group by 1
), named as (
  select q.trace_id as k, list(distinct name) as names
  from ({AU.RESOLVED_COLUMNS_SQL}) c join ({_RUN_QUERIES}) q using (query_id) where status in ('found', 'ambiguous') group by 1
), r as (
  select runs.*, o.*, k % 101 = 0 as lost, required_model, forbidden_model, coalesce(models, []) as models, coalesce(names, []) as names, f.message as claims,
         case when k % 13 = 0 then 'ambiguity' when k % 13 = 1 then 'rejection' else 'answer' end as wanted
  from runs join o on o.k = runs.case_id left join ({_MODELS}) w on w.trace_id = o.k left join used using (k) left join named using (k)
  left join ({CC.CLAIM_MESSAGES}) f on f.trace_id = o.k
), off as (
  select k, min(row_idx) as row_idx, arg_min(wanted, row_idx) as wanted, arg_min(got, row_idx) as got, arg_min(o_orderkey, row_idx) as o_orderkey
  from ({_PAIRS}) p where off group by k
), c as (
  select k, 1 as ordinal, 'expected_outcome' as name,
         case when lost then false when run_kind = 'answer' then wanted = 'answer'
              when run_kind = 'rejected' then wanted in ('ambiguity', 'rejection') else wanted = 'rejection' end as passed,
         case when run_kind <> 'answer' then error when not lost and wanted = 'answer' then 'Agent answered' else 'Expected rejection' end as message
  from r
  union all select k, 2, 'required_models', required_model is null or list_contains(models, required_model), concat('missing: ', required_model)
  from r where run_kind = 'answer' and not lost
  union all select k, 3, 'forbidden_models', forbidden_model is null or not list_contains(models, forbidden_model), concat('forbidden: ', forbidden_model)
  from r where run_kind = 'answer' and not lost
  union all select k, 4, 'required_columns', list_contains(names, 'id'), 'missing: id' from r where run_kind = 'answer' and not lost
  union all select k, 5, 'forbidden_columns', not list_contains(names, 'SIZE'), 'forbidden: SIZE' from r where run_kind = 'answer' and not lost
  union all select k, 6, 'supported_claims', claims is null, coalesce(claims, '') from r where run_kind = 'answer' and not lost
  union all select k, 7, 'result_match',
         case k % 8 when 2 then n = m and bad = 0 and small = 0 when 4 then n = 1 and only_key = 1
              when 5 then false when 6 then false when 7 then false else n = m and bad = 0 end,
         case when k % 8 = 5 then 'unknown comparison: sideways' when k % 8 = 6 then 'a keyed comparison needs keys'
              when k % 8 = 7 then 'tolerance is not a finite number of zero or more'
              when k % 8 = 4 then concat('expected scalar 1; got ', case when n = 1 then cast(only_key as varchar) else 'null' end)
              when n <> m then concat('expected ', m, ' rows; got ', n, ' rows')
              when k % 8 = 3 then concat('key ', o_orderkey, ': expected ', off.wanted, '; got ', off.got)
              else concat('row ', off.row_idx, ': expected ', off.wanted, '; got ', off.got) end
  from r left join off using (k) where run_kind = 'answer' and not lost and k % 10 <> 0
  union all select k, 8, 'row_count', n = 10, concat('expected 10, got ', n) from r where run_kind = 'answer' and not lost and k % 4 = 0
  union all select k, 9, 'shape', k % 12 <> 0, 'expected o_orderkey, o_totalprice; got o_orderkey, o_orderstatus, o_totalprice'
  from r where run_kind = 'answer' and not lost and k % 6 = 0
), v as (
  select k as trace_id, bool_and(passed) as passed, count(*) filter (where not passed) as n_failed,
         coalesce(string_agg(concat(name, ': ', message), '; ' order by ordinal) filter (where not passed), '') as message from c group by k
)
"""


@query("E00_evaluate", _ORACLE + "select trace_id, passed, n_failed, message from v")
def e00(spark, sf):
    return _verdicts(spark, sf)[0]


@query(
    "E00_suites",
    _ORACLE + """
select suite, count(*) as n_trials, count(*) filter (where ok) as n_passed, avg(case when ok then 1.0::double else 0.0::double end) as pass_rate
from (select suite, trial, bool_and(passed) as ok from v join runs using (trace_id) group by suite, trial) t group by suite
""",
)
def e00_suites(spark, sf):
    verdicts, runs = _verdicts(spark, sf, explain=False)
    return E.suite_rates(E.suite_trials(verdicts, runs))
