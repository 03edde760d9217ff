"""The run log as a stream: reading, de-duplication, windows, live verification and regression alerts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.ranking import HOT_ROWS, ranked
from plumbline.operators.rollup import match_live
from plumbline.session import scratch_path

RUN_SCHEMA = (
    "trace_id bigint, agent string, case_name string, question string, passed boolean, "
    "latency_ms double, created_at timestamp"
)
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def run_stream(
    spark: SparkSession,
    path: str,
    schema: str = RUN_SCHEMA,
    format: str = "parquet",
    files_per_trigger: int = 1000,
    glob: str | None = None,
) -> DataFrame:
    """Run records as they arrive in a folder; a trigger takes a bounded number of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(format).load(path)


def _marked(runs: DataFrame, delay: str) -> DataFrame:
    """With a watermark; one that an earlier step has set stays, since a query has one per time."""
    if "spark.watermarkDelayMs" in runs.schema["created_at"].metadata:
        return runs
    return runs.withWatermark("created_at", delay)


def drop_repeats(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each trace once, also when its record is written again within the delay."""
    return _marked(runs, delay).dropDuplicatesWithinWatermark(["trace_id"])


def pass_rate_windows(
    runs: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Runs, passes and latency per agent and time window."""
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return (
        _marked(runs, delay)
        .groupBy(window.alias("w"), "agent")
        .agg(
            F.count("*").alias("n_runs"),
            F.count_if("passed").alias("n_passed"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "agent",
            "n_runs",
            "n_passed",
            "max_latency_ms",
        )
    )


def activity_sessions(runs: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Spells of activity per agent that end after a gap."""
    return (
        _marked(runs, delay)
        .groupBy(F.session_window("created_at", gap).alias("w"), "agent")
        .agg(F.count("*").alias("n_runs"))
        .select(
            F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "agent", "n_runs"
        )
    )


def verify_stream(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs whose question an approved case asks, with that case; the cases are a static table."""
    return match_live(runs, cases)


class _Flips(StatefulProcessor):
    """Holds a case's runs until the watermark has passed them, then takes them in order of time.

    What comes in one trigger and what in the next makes no difference. The state of a case is its last
    outcome, the runs of one delay as packed columns (one entry per batch, not per run) and a single timer, at
    its earliest held run: when that fires, everything up to the watermark is there and is taken at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "outcome int")
        self.timer = handle.getValueState("timer", "ms bigint")
        self.held = handle.getListState("held", "trace_id binary, outcome binary, at binary")

    def _hold(self, trace_id: np.ndarray, outcome: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return trace_id.astype("<i8").tobytes(), outcome.astype("i1").tobytes(), at.astype("<i8").tobytes()

    def _wake(self, ms: int) -> None:
        """The timer stands at the earliest held run."""
        if self.timer.exists():
            before = int(self.timer.get()[0])
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["at"].to_numpy()
            if len(at):
                self.held.appendValue(self._hold(part["trace_id"].to_numpy(), part["outcome"].to_numpy(), at))
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self._wake(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.held.get())
        self.timer.clear()
        if not parts:
            return iter(())
        trace_id, outcome, at = (np.concatenate([np.frombuffer(p[i], dtype) for p in parts]) for i, dtype in enumerate(("<i8", "i1", "<i8")))
        due = at <= final
        self.held.clear()
        if not due.all():
            self.held.appendValue(self._hold(trace_id[~due], outcome[~due], at[~due]))
            self._wake(-(-int(at[~due].min()) // 1000))
        if not due.any():
            return iter(())
        trace_id, outcome, at = trace_id[due], outcome[due], at[due]
        order = np.lexsort((trace_id, at))
        trace_id, outcome, at = trace_id[order], outcome[order], at[order]
        was = np.concatenate([[self.last.get()[0] if self.last.exists() else 0], outcome[:-1]])
        self.last.update((int(outcome[-1]),))
        hit = (was == 1) & (outcome == 0)
        if not hit.any():
            return iter(())
        return iter([pd.DataFrame({"agent": key[0], "case_name": key[1], "trace_id": trace_id[hit], "at": at[hit]})])

    def close(self) -> None:
        pass


def regression_alerts(runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A row whenever a case of an agent fails after it passed the time before, in order of time.

    A run is judged once the watermark has passed it; runs that come later than the delay are left out.
    Needs the RocksDB state store (``STATE_STORE``) to be set when the query starts.
    """
    outcome = F.coalesce(F.col("passed").cast("int"), F.lit(-1))  # an unknown one is neither a pass nor a failure
    return (
        runs.where(F.col("created_at").isNotNull())
        .withWatermark("created_at", delay)
        .select("agent", "case_name", "trace_id", outcome.alias("outcome"), F.unix_micros("created_at").alias("at"), "created_at")
        .groupBy("agent", "case_name")
        .transformWithStateInPandas(
            statefulProcessor=_Flips(),
            outputStructType="agent string, case_name string, trace_id bigint, at bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
        .select("agent", "case_name", "trace_id", F.timestamp_micros("at").alias("created_at"))
    )


def regressions(runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same over a finished log; a busy case is split over tasks by its numbering."""
    numbered = ranked(
        runs.select("agent", "case_name", "created_at", "trace_id", "passed"),
        ["agent", "case_name"],
        ["created_at", "trace_id"],
        "pos",
        hot_rows,
    )
    # a run meets its predecessor at its own position
    at = numbered.select(
        "agent", "case_name", "trace_id", "created_at", "passed",
        F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(True).alias("own")),
                          F.struct((F.col("pos") + 1).alias("at"), F.lit(False).alias("own")))).alias("p"),
    ).select("agent", "case_name", "trace_id", "created_at", "passed", "p.at", "p.own")
    own = F.col("own")
    met = at.groupBy("agent", "case_name", "at").agg(
        F.max(F.when(own, F.col("trace_id"))).alias("trace_id"),
        F.max(F.when(own, F.col("created_at"))).alias("created_at"),
        F.bool_or(F.when(own, F.col("passed"))).alias("passed"),
        F.bool_or(F.when(~own, F.col("passed"))).alias("was"),
    )
    return met.where(F.col("was") & ~F.col("passed")).select("agent", "case_name", "trace_id", "created_at")


def run_available(stream: DataFrame, label: str, partition_by: tuple[str, ...] = (), at: tuple[str, str] | None = None) -> DataFrame:
    """Process everything that has arrived, write it below the shared folder and return the result table.

    State is kept in RocksDB, so that it may outgrow the executors' heap. With ``at``, a folder for the result and one for the progress,
    a later call, also of another process, goes on where the last one stopped: state, watermark and the files already read are kept.
    """
    spark = stream.sparkSession
    out, progress = at or (scratch_path(spark, label), scratch_path(spark, f"{label}-progress"))
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    key, rocksdb = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocksdb)
    try:
        writer.option("path", out).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(out)
