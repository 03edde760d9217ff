"""The evaluation of runs against their cases, from traces and expectations to checks and verdicts, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.compare import check_row_count, check_shape, compare, difference_report
from plumbline.session import cut, stored
from plumbline.operators.rollup import check_outcome, check_usage, pass_rate, rollup_suite, rollup_trace

#: Checks in the order in which they are made and their failures told.
ORDER = ("expected_outcome", "required_models", "forbidden_models", "required_columns", "forbidden_columns", "supported_claims",
         "result_match", "row_count", "shape")


def evaluate(runs: DataFrame, cases: DataFrame, usage: DataFrame, actual: DataFrame, expected: DataFrame, explain: bool = True) -> DataFrame:
    """One row ``(trace_id, ordinal, name, passed, message)`` per check of every run.

    ``runs(trace_id, case_id, run_kind, error, claims_passed, claims_message)``; ``cases(case_id, expected_outcome, required_models,
    forbidden_models, required_columns, forbidden_columns, verifies_result, mode, tolerance, allow_extra, keys, value, row_count,
    columns)``; ``usage(trace_id, subject, item)`` with subject 'models' or 'columns'; ``actual`` rows by trace and ``expected`` rows by
    case, both as ``cmp_id``. A run that did not answer has the outcome as its only check. A run without a case fails.
    Without ``explain`` a failed comparison is not read again for the difference that its message tells; who asks only what passed needs none.
    """
    known = runs.join(cases, "case_id", "left")
    outcome = check_outcome(known.withColumn("expected_outcome", F.coalesce("expected_outcome", F.lit("a known case"))))
    answered = known.where((F.col("run_kind") == "answer") & F.col("expected_outcome").isNotNull())
    parts = [outcome.select("trace_id", "name", F.coalesce("passed", F.lit(False)).alias("passed"), "message")]
    for subject in ("models", "columns"):
        wanted = answered.select(F.col("trace_id").alias("case_id"), F.col(f"required_{subject}").alias("required"), F.col(f"forbidden_{subject}").alias("forbidden"))
        used = usage.where(F.col("subject") == subject).select(F.col("trace_id").alias("case_id"), "item")
        parts.append(check_usage(wanted, used, subject).withColumnRenamed("case_id", "trace_id"))
    parts.append(answered.select(
        "trace_id", F.lit("supported_claims").alias("name"), F.coalesce("claims_passed", F.lit(False)).alias("passed"),
        F.coalesce("claims_message", F.lit("")).alias("message")))

    judged = answered.withColumn("cmp_id", F.col("trace_id"))
    specs = judged.where("verifies_result").select("cmp_id", "mode", "tolerance", "allow_extra", "keys", "value")
    # every mode and every report reads the rows; each side is numbered and written once
    rows = stored(actual.join(judged.select("cmp_id"), "cmp_id", "left_semi"), "actual-rows")
    wanted_rows = stored(expected.withColumnRenamed("cmp_id", "case_id").join(
        judged.where("verifies_result").select("case_id", "cmp_id"), "case_id").select(*expected.columns), "expected-rows")
    verdicts = cut(compare(rows, wanted_rows, specs))
    told = verdicts.withColumn("message", F.lit(""))
    if explain:
        told = verdicts.join(difference_report(rows, wanted_rows, specs, verdicts), "cmp_id", "left")
    matched = told.select("cmp_id", F.lit("result_match").alias("name"), "passed", F.coalesce("message", F.lit("")).alias("message"))
    checks = [matched,
              check_row_count(rows, judged.where("row_count is not null").select("cmp_id", "row_count")),
              check_shape(rows, judged.where("size(columns) > 0").select("cmp_id", "columns"))]
    parts += [c.withColumnRenamed("cmp_id", "trace_id") for c in checks]

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part.select("trace_id", "name", "passed", "message"))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("name")).cast("int")
    return found.select("trace_id", place.alias("ordinal"), "name", "passed", "message")


def case_verdicts(checks: DataFrame) -> DataFrame:
    """``(trace_id, passed, n_failed, message)``: all failures of a run in the order of its checks."""
    return rollup_trace(checks).drop("correctness_verified")


def suite_trials(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases of every suite and trial; ``runs`` has ``trace_id, suite, trial``."""
    return rollup_suite(verdicts.join(runs.select("trace_id", "suite", "trial"), "trace_id"), "suite", "trial")


def suite_rates(trials: DataFrame) -> DataFrame:
    return pass_rate(trials, "suite")
