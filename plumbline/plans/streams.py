"""S: the run log as a stream, processed until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, view
from plumbline.streaming import runs as L

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _runs(spark, sf):
    events = L.run_stream(spark, sf, _EVENTS, glob="events.parquet")
    return events.select(
        F.col("event_id").alias("trace_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % 20).alias("agent"),
        F.col("event_type").alias("case_name"),
        F.concat(F.lit("  WHAT about "), "event_type", F.lit("?")).alias("question"),
        (F.col("event_type") != "error").alias("passed"),
        F.col("value").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def _plain(df, *times):
    """Zone-less times, as the tables have them."""
    for t in times:
        df = df.withColumn(t, F.col(t).cast("timestamp_ntz"))
    return df


@query(
    "S01_run_stream",
    f"select trace_id, agent, case_name, passed, latency_ms, created_at from ({fx.RUNS}) r",
)
def s01(spark, sf):
    out = L.run_available(_runs(spark, sf).drop("question"), "runs")
    return _plain(out, "created_at")


@query("S02_drop_repeats", f"select trace_id, agent, created_at from ({fx.RUNS}) r")
def s02(spark, sf):
    runs = _runs(spark, sf)
    repeated = runs.unionByName(_runs(spark, sf).where("latency_ms > 20"))
    out = L.run_available(L.drop_repeats(repeated).select("trace_id", "agent", "created_at"), "once")
    return _plain(out, "created_at")


_CLOSED = "(select max(ts) - interval 10 minute from events)"


@query(
    "S03_pass_rate_windows",
    f"""
select window_start, window_start + interval 1 hour as window_end, agent, count(*) as n_runs,
       count(*) filter (where passed) as n_passed, max(latency_ms) as max_latency_ms
from (select *, date_trunc('hour', created_at) as window_start from ({fx.RUNS}) r) t
where window_start + interval 1 hour <= {_CLOSED}
group by 1, 2, 3
""",
)
def s03(spark, sf):
    out = L.run_available(L.pass_rate_windows(_runs(spark, sf), "1 hour"), "windows")
    return _plain(out, "window_start", "window_end")


@query(
    "S03_sliding_windows",
    f"""
select window_start, window_start + interval 2 hour as window_end, agent, count(*) as n_runs,
       count(*) filter (where passed) as n_passed, max(latency_ms) as max_latency_ms
from (select *, date_trunc('hour', created_at) - to_hours(b) as window_start
      from ({fx.RUNS}) r, (values (0), (1)) v(b)) t
where window_start + interval 2 hour <= {_CLOSED}
group by 1, 2, 3
""",
)
def s03_sliding(spark, sf):
    out = L.run_available(L.pass_rate_windows(_runs(spark, sf), "2 hours", "1 hour"), "sliding")
    return _plain(out, "window_start", "window_end")


@query(
    "S04_sessions",
    f"""
with m as (select *, case when created_at < lag(created_at) over w + interval 30 minute then 0 else 1 end as fresh
           from ({fx.RUNS}) r window w as (partition by agent order by created_at, trace_id)),
     s as (select *, sum(fresh) over (partition by agent order by created_at, trace_id) as sid from m)
select min(created_at) as session_start, max(created_at) + interval 30 minute as session_end, agent, count(*) as n_runs
from s group by agent, sid having max(created_at) + interval 30 minute <= {_CLOSED}
""",
)
def s04(spark, sf):
    out = L.run_available(L.activity_sessions(_runs(spark, sf), "30 minutes"), "sessions")
    return _plain(out, "session_start", "session_end")


@query(
    "S05_live_verification",
    "select event_id as trace_id, concat('approved-', event_type) as case_name from events where event_type in ('click', 'view')",
)
def s05(spark, sf):
    cases = (
        view(spark, sf, "select distinct event_type from events")
        .where("event_type in ('click', 'view')")
        .select(
            F.concat(F.lit("what  about "), "event_type", F.lit("? ")).alias("question"),
            F.lit("s").alias("suite"),
            F.lit("d").alias("suite_digest"),
            F.concat(F.lit("approved-"), "event_type").alias("case_name"),
            F.lit("answer").alias("expected_outcome"),
            F.lit(True).alias("verifies_result"),
            F.lit("any").alias("agent"),
        )
    )
    runs = _runs(spark, sf).withColumn("agent", F.lit("any")).drop("case_name")
    return L.run_available(L.verify_stream(runs, cases).select("trace_id", "case_name"), "live")


_FLIPS = f"""
select agent, case_name, trace_id, created_at
from (select agent, 'any' as case_name, trace_id, created_at, passed,
             lag(passed) over (partition by agent order by created_at, trace_id) as was from ({fx.RUNS}) r) t
where was and not passed
"""


# A run is judged once the watermark has passed it.
@query("S06_regression_alerts", f"select * from ({_FLIPS}) f where created_at <= {_CLOSED}")
def s06(spark, sf):
    alerts = L.regression_alerts(_runs(spark, sf).withColumn("case_name", F.lit("any")))
    return _plain(L.run_available(alerts, "alerts"), "created_at")


@query("S06_regressions_batch", _FLIPS)
def s06_batch(spark, sf):
    return L.regressions(view(spark, sf, fx.RUNS).withColumn("case_name", F.lit("any")))
