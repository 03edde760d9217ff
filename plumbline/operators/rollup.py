"""From checks to cases, suites and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import case_slug, normalize_question


def check_outcome(runs: DataFrame) -> DataFrame:
    """Adds ``name, passed, message, final`` to runs with ``expected_outcome, run_kind, error``.

    ``run_kind`` is 'answer', 'rejected', 'invalid_sql' or 'error'. A run that raised has this as its
    only check (``final``).
    """
    expected, kind = F.col("expected_outcome"), F.col("run_kind")
    answered = kind == "answer"
    passed = F.when(answered, expected == "answer").otherwise(
        ((expected == "ambiguity") & (kind == "rejected"))
        | ((expected == "rejection") & kind.isin("rejected", "invalid_sql"))
    )
    return runs.withColumns(
        {
            "name": F.lit("expected_outcome"),
            "passed": passed,
            "message": F.when(~answered, F.col("error"))
            .when(expected == "answer", "Agent answered")
            .otherwise("Expected rejection"),
            "final": ~answered,
        }
    )


def check_usage(cases: DataFrame, usage: DataFrame, subject: str = "models") -> DataFrame:
    """Required items must be used, forbidden ones must not.

    ``cases(case_id, required array, forbidden array)``, ``usage(case_id, item)``. Two checks per case;
    a message lists the offending items, which are at most those the case itself names.
    """

    def listed(column: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda i: F.struct(
            F.lit(column).alias("rule"), i.alias("item")))

    wanted = cases.select(
        "case_id", F.explode(F.concat(listed("required"), listed("forbidden"))).alias("w")
    ).select("case_id", "w.rule", "w.item").distinct()
    used = usage.select("case_id", "item").distinct().withColumn("used", F.lit(True))
    hit = F.coalesce("used", F.lit(False))
    offending = (
        wanted.join(used, ["case_id", "item"], "left")
        .where(F.when(F.col("rule") == "required", ~hit).otherwise(hit))
        .groupBy("case_id", "rule")
        .agg(F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("items"))
    )
    rules = cases.select("case_id", F.explode(F.array(F.lit("required"), F.lit("forbidden"))).alias("rule"))
    label = F.when(F.col("rule") == "required", "missing: ").otherwise("forbidden: ")
    return rules.join(offending, ["case_id", "rule"], "left").select(
        "case_id",
        F.concat("rule", F.lit(f"_{subject}")).alias("name"),
        F.col("items").isNull().alias("passed"),
        F.coalesce(F.concat(label, "items"), F.lit("")).alias("message"),
    )


def rollup_trace(checks: DataFrame) -> DataFrame:
    """``checks(trace_id, ordinal, name, passed, message)`` to one verdict per trace.

    Messages of failed checks are joined in order. Checks are first reduced to one per trace and name;
    names come from a fixed vocabulary plus the approved cases, which bounds the joined text.
    Correctness needs an approved case among them, all of those passed, and everything else too.
    """
    text = F.concat("name", F.lit(": "), F.coalesce(F.nullif("message", F.lit("")), F.lit("failed")))
    named = (
        checks.groupBy("trace_id", "name")
        .agg(
            F.bool_and("passed").alias("passed"),
            F.min("ordinal").alias("ordinal"),
            F.min_by("message", F.when(~F.col("passed"), F.struct("ordinal", "message"))).alias("message"),
        )
    )
    failed = F.collect_list(F.when(~F.col("passed"), F.struct("ordinal", text.alias("text"))))
    approved = F.startswith("name", F.lit("correctness_eval:"))
    return (
        named.groupBy("trace_id")
        .agg(
            F.bool_and("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("n_failed"),
            F.array_sort(failed).alias("failed"),
            F.count_if(approved).alias("n_approved"),
        )
        .select(
            "trace_id",
            "passed",
            "n_failed",
            F.array_join(F.transform("failed", lambda f: f["text"]), "; ").alias("message"),
            ((F.col("n_approved") > 0) & F.col("passed")).alias("correctness_verified"),
        )
    )


def rollup_case(checks: DataFrame, *keys: str) -> DataFrame:
    """A case passes when all of its checks pass."""
    return checks.groupBy(*keys).agg(
        F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed")
    )


def rollup_suite(case_results: DataFrame, *keys: str) -> DataFrame:
    """A suite passes when all of its cases pass."""
    return case_results.groupBy(*keys).agg(
        F.bool_and("passed").alias("passed"),
        F.count("*").alias("n_cases"),
        F.count_if("passed").alias("n_passed"),
    )


def expand_trials(suites: DataFrame, override: int | None = None) -> DataFrame:
    """One row per independent trial of a suite."""
    trials = F.lit(override) if override else F.col("trials")
    return suites.withColumn("trials", trials).withColumn("trial", F.explode(F.sequence(F.lit(1), "trials")))


def pass_rate(suite_results: DataFrame, *keys: str) -> DataFrame:
    """Passed suite trials over all suite trials."""
    return suite_results.groupBy(*keys).agg(
        F.count("*").alias("n_trials"),
        F.count_if("passed").alias("n_passed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )


def filter_cases(cases: DataFrame, agent: str | None = None, case_name: str | None = None) -> DataFrame:
    """Cases of an agent and name; it is an error when none is left."""
    chosen = cases
    if agent is not None:
        chosen = chosen.where(F.col("agent") == agent)
    if case_name is not None:
        chosen = chosen.where(F.col("case_name") == case_name)
    if chosen.isEmpty():
        raise ValueError("No matching eval cases were found")
    return chosen


def coverage(agents: DataFrame, cases: DataFrame) -> DataFrame:
    """Result-verifying answer cases per agent; an agent without any is not covered."""
    counting = (F.col("expected_outcome") == "answer") & F.col("verifies_result")
    counts = cases.groupBy("agent").agg(F.count_if(counting).alias("n_cases"))
    n = F.coalesce("n_cases", F.lit(0))
    return agents.select("agent").join(counts, "agent", "left").select(
        "agent", n.alias("n_cases"), (n > 0).alias("covered")
    )


def match_live(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Approved result-verifying cases asking the same question of the same agent, per run."""
    approved = cases.where((F.col("expected_outcome") == "answer") & F.col("verifies_result"))
    c = approved.select(
        "agent", normalize_question(F.col("question")).alias("asked"), "suite", "suite_digest", "case_name"
    )
    r = runs.withColumn("asked", normalize_question(F.col("question")))
    return r.join(c, ["agent", "asked"]).drop("asked")


def verify_live(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """VERIFIED when at least one approved case matches, all of them pass and the run itself passed.

    ``runs(trace_id, passed)``, ``matches(trace_id, suite, suite_digest, case_name, case_passed)``.
    The digest is that of the last matching suite.
    """
    found = matches.groupBy("trace_id").agg(
        F.count("*").alias("n_matched"),
        F.bool_and("case_passed").alias("cases_passed"),
        F.max_by("suite_digest", F.struct("suite", "case_name")).alias("suite_digest"),
    )
    verified = F.coalesce(F.col("cases_passed") & F.col("passed"), F.lit(False))
    return runs.select("trace_id", "passed").join(found, "trace_id", "left").select(
        "trace_id",
        F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        F.when(verified, "VERIFIED").otherwise("UNVERIFIED").alias("status"),
        "suite_digest",
        F.when(F.col("n_matched").isNull(), "No approved eval case exactly matches this question")
        .when(~F.col("cases_passed"), "An approved eval case failed")
        .when(~F.col("passed"), "A check of the run failed")
        .otherwise("Approved eval matched")
        .alias("message"),
    )


def expand_cases(cases: DataFrame) -> DataFrame:
    """Approved cases ``(suite, case_name, question, ...)`` with their three starter companions.

    The case itself and its paraphrase keep every other column, the expectation among them; in the other two it is null.
    """
    name, question = F.col("case_name"), F.col("question")
    kept = [c for c in cases.columns if c not in ("suite", "case_name", "question", "expected_outcome")]

    def variant(suffix: str, text: Column, outcome: str, same: bool) -> Column:
        return F.struct(
            F.concat(name, F.lit(suffix)).alias("case_name"),
            text.alias("question"),
            F.lit(outcome).alias("expected_outcome"),
            *[(F.col(c) if same else F.lit(None).cast(cases.schema[c].dataType)).alias(c) for c in kept],
        )

    variants = F.array(
        variant("", question, "answer", True),
        variant("-paraphrase", F.concat(F.lit(fixed.PARAPHRASE_PREFIX), question), "answer", True),
        variant("-ambiguity", F.lit(fixed.AMBIGUOUS_QUESTION), "ambiguity", False),
        variant("-out-of-scope", F.lit(fixed.OUT_OF_SCOPE_QUESTION), "rejection", False),
    )
    return cases.select("suite", F.explode(variants).alias("v")).select("suite", "v.*")


def name_collisions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New cases whose name the suite already has."""
    return new.join(existing.select("suite", "case_name"), ["suite", "case_name"], "left_semi")


def merge_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append new cases; a suite with a colliding name takes none of them."""
    blocked = name_collisions(existing, new).select("suite").distinct()
    return existing.unionByName(new.join(blocked, "suite", "left_anti"), allowMissingColumns=True)


def name_cases(questions: DataFrame, question: str = "question") -> DataFrame:
    return questions.withColumn("case_name", case_slug(F.col(question)))
