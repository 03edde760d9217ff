"""G: observability and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import observe as O
from plumbline.plans import fixtures as fx
from plumbline.plans import scopes as B
from plumbline.plans.registry import query, table, view
from plumbline.session import cut


def _traces(spark, sf):
    events = view(spark, sf, fx.RUNS)
    return events.select(
        "trace_id",
        F.concat(F.lit("What about "), "case_name", F.lit("?")).alias("question"),
        F.struct(
            F.col("case_name").alias("intent"),
            F.array(F.col("case_name"), F.col("agent")).alias("metrics"),
            F.array(F.lit("day")).alias("dimensions"),
            F.to_date("created_at").alias("start_date"),
            F.lit(None).cast("string").alias("end_date"),
            F.array().cast("array<string>").alias("assumptions"),
        ).alias("interpretation"),
        F.struct(
            F.array(F.create_map(F.lit("amount"), F.col("latency_ms").cast("decimal(10,2)"))).alias("rows"),
            F.lit(1).cast("bigint").alias("row_count"),
        ).alias("result"),
        "agent",
        F.struct(
            F.col("latency_ms").alias("latency_ms"),
            F.length("props").cast("bigint").alias("prompt_tokens"),
            F.length("case_name").cast("bigint").alias("completion_tokens"),
        ).alias("usage"),
        F.col("created_at"),
    )


@query(
    "G01_trace_json",
    """
select event_id as trace_id, concat('What about ', event_type, '?') as question, event_type as intent,
       cast(cast(ts as date) as varchar) as start_date, cast(cast(value as decimal(10,2)) as varchar) as amount,
       value as latency_ms, cast(cast(ts as date) as varchar) as created_day
from events
""",
)
def g01(spark, sf):
    parsed = O.parse_traces(O.trace_json(_traces(spark, sf), "trace_id"))
    return parsed.select(
        "trace_id",
        "question",
        "interpretation.intent",
        "interpretation.start_date",
        F.col("result.rows")[0]["amount"].alias("amount"),
        "usage.latency_ms",
        F.substring("created_at", 1, 10).alias("created_day"),
    )


@query(
    "G02_usage",
    f"""
select agent, cast(cast(created_at as date) as varchar) as day, count(*) as n_runs, avg(latency_ms) as avg_latency_ms,
       max(latency_ms) as max_latency_ms, cast(sum(length(props)) as bigint) as prompt_tokens,
       cast(sum(length(case_name)) as bigint) as completion_tokens
from ({fx.RUNS}) r group by 1, 2
""",
)
def g02(spark, sf):
    flat = _traces(spark, sf).select("agent", F.to_date("created_at").cast("string").alias("day"), "usage.*")
    return O.usage_report(flat, "agent", "day")


# A quantile told by merged sketches lies between the exact ones a share of the runs below and above.
_RANK_ERROR = 0.02


@query(
    "G02_latency_percentiles",
    f"""
select agent, count(*) as n_runs, true as p50_close, true as p95_close, true as p99_close, count(distinct cast(created_at as date)) as n_days
from ({fx.RUNS}) r group by agent
""",
)
def g02_percentiles(spark, sf):
    """Sketches per agent and day, stored; quantiles per agent from them, held against the ranks in the exact distribution."""
    runs = _traces(spark, sf).select("agent", F.to_date("created_at").alias("day"), F.col("usage.latency_ms").alias("latency_ms"))
    stored = cut(O.latency_sketches(runs, "agent", "day"))
    days = stored.groupBy("agent").agg(F.count("*").alias("n_days"))
    told = O.latency_quantiles(stored, "agent").withColumnRenamed("n_runs", "n")
    met = runs.join(told, "agent")

    def close(p: int):
        value = F.col(f"p{p}_latency_ms")
        below, upto = F.count_if(F.col("latency_ms") < value), F.count_if(F.col("latency_ms") <= value)
        n = F.count("*")
        return ((below <= n * (p / 100 + _RANK_ERROR)) & (upto >= n * (p / 100 - _RANK_ERROR))).alias(f"p{p}_close")

    return met.groupBy("agent").agg(F.max("n").alias("n_runs"), close(50), close(95), close(99)).join(days, "agent")


# The tests of a part change with the snapshot; a run is judged by the one in force. Large parts have a test without a status.
_PART_TESTS = """
select manifest_digest, p_partkey as target_id,
       concat(case when manifest_digest = 'n' and p_size > 10 then 'unique_' else 'not_null_' end, cast(p_partkey % 50 as varchar(4))) as name,
       case when p_size < 20 then 'pass' when p_size < 40 and manifest_digest = 'm' then 'fail' end as status
from part cross join (values ('m'), ('n')) as d(manifest_digest)
"""


@query(
    "G03_test_health",
    f"""
select distinct l_orderkey as trace_id, name, status
from lineitem join ({fx.QUERY_DIGESTS}) q on l_orderkey = query_id join ({_PART_TESTS}) t using (manifest_digest)
where l_partkey = target_id
""",
)
def g03(spark, sf):
    runs = B.queries(spark, sf).select(F.col("query_id").alias("trace_id"), "manifest_digest")
    usage = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_partkey").alias("unique_id")
    ).join(runs, "trace_id")
    return O.test_health(usage, view(spark, sf, _PART_TESTS))


# Payloads: most fit; some break a rule each, some do not parse.
_PAYLOADS = """
select event_id, event_type, value,
       case when value > 300 then concat(props, '}')
            when value > 200 then '{}'
            when value > 150 then concat('{"k": "', event_type, '"}')
            when value > 120 then concat(substr(props, 1, length(props) - 1), ', "zz": 1, "extra": [1]}')
            when value > 90 then '{"k": null, "list": ["a", "b"]}'
            when value > 70 then '{"k": 1, "list": ["a", 7]}'
            when value > 60 then '[1]'
            else props end as payload
from events
"""
_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["k"],
    "properties": {
        "k": {"type": ["integer", "null"]},
        "list": {"type": "array", "items": {"type": "string"}},
    },
}


@query(
    "G04_validate_json",
    """
select event_id,
       case when value > 300 then 'malformed JSON'
            when value > 200 then 'Structured output $ is missing: k'
            when value > 150 then 'Structured output $.k must have type integer or null'
            when value > 120 then 'Structured output $ has unexpected fields: extra, zz'
            when value > 90 then null
            when value > 70 then 'Structured output $.list[1] must have type string'
            when value > 60 then 'Structured output $ must have type object' end as problem
from events
""",
)
def g04(spark, sf):
    return O.validate_json(view(spark, sf, _PAYLOADS), "payload", _SCHEMA).select("event_id", "problem")


_RESPONSES = r"""
select event_id, value, props,
       case when value > 200 then concat('```json', chr(10), props, chr(10), '```')
            when value > 150 then concat('Here is {the} result: ', props, ' and more {')
            when value > 100 then concat('No object at all in ', event_type)
            when value > 80 then concat('```', chr(10), '[', props, ']', chr(10), '```')
            when value > 60 then concat('Result:', chr(10), '```json', chr(10), props, chr(10), '```')
            else concat('  ', props, ' ') end as response
from events
"""


@query(
    "G05_extract_json",
    """
select event_id,
       case when value > 80 and value <= 150 then null else cast(json_extract_string(props, '$.k') as bigint) end as k,
       case when value > 100 and value <= 150 then 'malformed JSON'
            when value > 80 and value <= 100 then 'Model structured output must be an object' end as problem
from events
""",
)
def g05(spark, sf):
    found = O.extract_json(view(spark, sf, _RESPONSES), "response")
    return found.select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"), "problem")


@query(
    "G06_metrics",
    f"""
select metric, count(*) as n_runs
from (select case_name as metric from ({fx.RUNS}) r union all select agent from ({fx.RUNS}) r) m group by metric
""",
)
def g06(spark, sf):
    return O.metric_usage(_traces(spark, sf))


@query(
    "G06_interpretations",
    "select event_id as trace_id, event_type as intent, concat(event_type, ',agent_', user_id % 20) as metrics from events",
)
def g06_columns(spark, sf):
    return O.interpretations(_traces(spark, sf), "trace_id").select(
        "trace_id", "intent", F.array_join("metrics", ",").alias("metrics")
    )


@query(
    "G07_data_tests",
    """
with t as (
select 'orders' as table_name, 'not_null' as test, 'o_orderkey' as column_name, count(*) filter (where o_orderkey is null) as failures from orders
union all select 'orders', 'not_null', 'o_orderdate', count(*) filter (where o_orderdate is null) from orders
union all select 'orders', 'unique', 'o_custkey', (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1) x)
union all select 'orders', 'primary_key', 'o_orderkey', (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) x)
union all select 'lineitem', 'not_null', 'l_orderkey', count(*) filter (where l_orderkey is null) from lineitem
union all select 'lineitem', 'not_null', 'l_linenumber', count(*) filter (where l_linenumber is null) from lineitem
union all select 'lineitem', 'primary_key', 'l_orderkey, l_linenumber',
          (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) x))
select *, case when failures = 0 then 'pass' else 'fail' end as status from t
""",
)
def g07(spark, sf):
    orders = O.run_data_tests(
        table(spark, sf, "orders"),
        "orders",
        not_null=["o_orderkey", "o_orderdate"],
        unique=["o_custkey"],
        primary_key=["o_orderkey"],
    )
    lines = O.run_data_tests(
        table(spark, sf, "lineitem"), "lineitem", primary_key=["l_orderkey", "l_linenumber"]
    )
    return orders.unionByName(lines)
