"""JSON salvage and schema checks, roll-ups, data tests, streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import authoring as W
from plumbline.operators import observe as O
from plumbline.operators import rollup as R
from plumbline.session import drop_scratch, scratch_path
from plumbline.sources.tables import SourceSpec, source
from plumbline.streaming import runs as L

SCHEMA = {"type": "object", "additionalProperties": False, "required": ["depth"],
          "properties": {"depth": {"type": "integer"}, "drift": {"type": ["number", "null"]},
                         "probes": {"type": "array", "items": {"type": "object", "required": ["tag"]}}}}


@pytest.mark.parametrize(("text", "problem"), [
    ('{"depth": 7}', None), ('{"drift": null, "depth": -3}', None), ('{"depth": 12345678901234567890}', None),
    ("{}", "Structured output $ is missing: depth"),
    ('{"depth": 7, "colour": true}', "Structured output $ has unexpected fields: colour"),
    ('{"depth": "7"}', "Structured output $.depth must have type integer"),
    ('{"depth": 7.0}', "Structured output $.depth must have type integer"), ('{"depth": 7, "drift": 2.50}', None),
    ('{"depth": 7, "drift": "9.5, 1.0"}', "Structured output $.drift must have type number or null"),
    ('{"depth": 0.25}', "Structured output $.depth must have type integer"),
    ('{"depth": 1, "drift": "x"}', "Structured output $.drift must have type number or null"),
    ('{"depth": 1, "probes": [{"tag": 1}, {}]}', "Structured output $.probes[1] is missing: tag"),
    ("[1]", "Structured output $ must have type object"), ('{"depth": 1}}', "malformed JSON"),
    ('{"depth": 1} {"depth": 2}', "malformed JSON"), ("", "malformed JSON")])
def test_payload_schema(spark, text, problem):
    df = spark.createDataFrame([(text,)], "t string")
    assert O.validate_json(df, "t", SCHEMA).first().problem == problem


def test_json_is_salvaged_from_responses(spark):
    texts = ['```json\n{"depth": 7}\n```', 'My measurement, as asked:\n```json\n{"depth": 7}\n```', "```json\n[7]\n```",
             "no object", '{half {"depth": 7} and more', '{"depth": 6, "depth": 7}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = O.extract_json(df, "t").orderBy("i").select(
        F.try_variant_get("doc", "$.depth", "int").alias("a"), "problem").collect()
    assert [r.a for r in rows] == [7, 7, None, None, 7, 7]
    assert rows[2].problem == "Model structured output must be an object" and rows[3].problem == "malformed JSON"


def test_outcomes(spark):
    cases = [("answer", "answer", True), ("ambiguity", "rejected", True), ("rejection", "rejected", True),
             ("rejection", "invalid_sql", True), ("ambiguity", "invalid_sql", False), ("answer", "error", False),
             ("rejection", "answer", False)]
    df = spark.createDataFrame([(e, k, "x", w) for e, k, w in cases],
                               "expected_outcome string, run_kind string, error string, want boolean")
    assert all(r.passed == r.want for r in R.check_outcome(df).collect())


def test_invalid_expectations(spark):
    schema = ("suite string, agent string, case_name string, question string, comparison string, tolerance double, "
              "keys array<string>, row_count int, expected_outcome string, has_reference boolean, has_rows boolean, "
              "has_value boolean, kind string, trials int")
    good = dict(suite="s", agent="a", case_name="c", question="q", comparison="unordered", tolerance=0.0, keys=None,
                row_count=None, expected_outcome="answer", has_reference=False, has_rows=True, has_value=False,
                kind="regression", trials=1)
    bad = [{}, {"comparison": "guess"}, {"tolerance": -1.0}, {"comparison": "keyed"}, {"row_count": -1},
           {"tolerance": float("nan")}, {"trials": 21}, {"has_reference": True}, {"question": " "}]
    rows = [{**good, "case_name": f"c{i}", **b} for i, b in enumerate(bad)]
    rows += [{**good, "case_name": "twice"}, {**good, "case_name": "twice"}]
    got = {}
    for r in W.validate_cases(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.case_name, []).append(len(r.errors))
    assert got.pop("c0") == [0] and got.pop("twice") == [1, 1] and all(n == [1] for n in got.values())


def test_live_status(spark):
    runs = spark.createDataFrame([(1, "a", "  WHERE is  the buoy? ", True), (2, "a", "new?", True), (3, "a", "broken?", True),
                                  (4, "b", "where is the buoy?", True), (5, "a", "where is the buoy?", False)],
                                 "trace_id int, agent string, question string, passed boolean")
    cases = spark.createDataFrame([("s", "d", "a", "buoy", "Where is the buoy?", "answer", True),
                                   ("s", "d", "a", "x", "new?", "answer", False), ("s", "d", "a", "y", "broken?", "answer", True)],
                                  "suite string, suite_digest string, agent string, case_name string, question string, "
                                  "expected_outcome string, verifies_result boolean")
    matches = R.match_live(runs, cases).withColumn("case_passed", F.col("case_name") != "y")
    got = {r.trace_id: (r.status, r.n_matched) for r in R.verify_live(runs, matches).collect()}
    assert got == {1: ("VERIFIED", 1), 2: ("UNVERIFIED", 0), 3: ("UNVERIFIED", 1), 4: ("UNVERIFIED", 0), 5: ("UNVERIFIED", 1)}


def test_data_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "b")], "id int, v string")
    got = {(r.test, r.column_name): (r.failures, r.status)
           for r in O.run_data_tests(df, "t", not_null=["v"], unique=["v"], primary_key=["id"]).collect()}
    assert got == {("not_null", "v"): (1, "fail"), ("not_null", "id"): (1, "fail"), ("unique", "v"): (1, "fail"),
                   ("primary_key", "id"): (1, "fail")}


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_alerts_do_not_depend_on_the_triggers(spark, tmp_path, files):
    """Four files with interleaved times, so that later ones hold earlier runs; a last one moves the watermark on."""
    data = [(i, f"a{i % 2}", "c", "q", i % 3 != 0, float(i), f"2026-01-01 00:{i:02d}:00") for i in range(40)]
    data.append((99, "a9", "c", "q", True, 0.0, "2026-01-01 03:00:00"))
    df = spark.createDataFrame(data, "trace_id bigint, agent string, case_name string, question string, passed boolean, "
                                     "latency_ms double, created_at string")
    df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    for part in (3, 1, 0, 2):
        df.where(f"trace_id % 4 = {part} and trace_id < 99").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    df.where("trace_id = 99").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = L.run_stream(spark, str(tmp_path / "log"), files_per_trigger=files)
    live = sorted(r.trace_id for r in L.run_available(L.regression_alerts(stream, "1 hour"), "t").collect())
    batch = sorted(r.trace_id for r in L.regressions(df).collect())
    assert live == batch == sorted(r.trace_id for r in L.regressions(df, hot_rows=5).collect()) and batch


class _Handle:
    """State of one case in memory; counts the timers that stand."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return _Value()

    def getListState(self, name, schema):
        return _Entries()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Entries(list):
    appendValue, get = list.append, list.copy

    def appendList(self, values):
        self.extend(values)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_case_has_one_timer_however_many_runs_wait():
    n = 1000
    flips, handle = L._Flips(), _Handle()
    flips.init(handle)
    at = np.arange(n) * 1_000_000 + 500
    rows = pd.DataFrame({"trace_id": np.arange(n), "passed": np.arange(n) % 3 != 2, "outcome": (np.arange(n) % 3 != 2).astype(int), "at": at,
                         "created_at": pd.to_datetime(at, unit="us")})
    flips.handleInputRows(("a", "c"), iter([rows[500:], rows[:500]]), None)
    assert handle.timers == {1}
    handle.timers.clear()  # the engine takes a timer that has fired
    found = list(flips.handleExpiredTimer(("a", "c"), _Now(600_000), None))
    assert sorted(found[0]["trace_id"]) == [i for i in range(600) if i % 3 == 2]
    assert handle.timers == {600_001}
    found = list(flips.handleExpiredTimer(("a", "c"), _Now(10**9), None))
    assert sorted(found[0]["trace_id"]) == [i for i in range(600, n) if i % 3 == 2]


def test_an_unknown_outcome_is_no_failure(spark, tmp_path):
    rows = [(1, True, "00:01"), (2, None, "00:02"), (3, False, "00:03"), (4, True, "00:04"), (5, False, "00:05"), (99, True, "09:00")]
    df = spark.createDataFrame(rows, "trace_id bigint, passed boolean, at string").selectExpr(
        "trace_id", "'a' as agent", "'c' as case_name", "'q' as question", "passed", "1.0D as latency_ms", "cast('2026-01-01 ' || at || ':00' as timestamp) as created_at")
    for part in ("trace_id < 99", "trace_id = 99"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    found = L.run_available(L.regression_alerts(L.run_stream(spark, str(tmp_path / "log"), files_per_trigger=1)), "unknown")
    assert [(r.trace_id, str(r.created_at)) for r in found.collect()] == [(5, "2026-01-01 00:05:00")]


def test_jdbc_must_be_split_or_small(spark):
    with pytest.raises(ValueError, match="partitionColumn, lowerBound"):
        source(spark, SourceSpec("jdbc", {"url": "jdbc:x", "dbtable": "t"}))


def test_scratch_tables_are_dropped(spark):
    path = scratch_path(spark, "kept")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) >= 1 and drop_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_starter_cases_keep_their_expectation(spark):
    cases = spark.createDataFrame([("s", "c", "how many?", ["k"], 3)], "suite string, case_name string, question string, keys array<string>, row_count int")
    got = {r.case_name: (r["keys"], r.row_count, r.expected_outcome) for r in R.expand_cases(cases).collect()}
    assert got == {"c": (["k"], 3, "answer"), "c-paraphrase": (["k"], 3, "answer"), "c-ambiguity": (None, None, "ambiguity"), "c-out-of-scope": (None, None, "rejection")}
