"""Validation of authored tables: evaluation cases and agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed


def _errors(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that hold; an undecidable rule counts as held."""
    found = [F.when(F.coalesce(broken, F.lit(True)), message) for broken, message in rules]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) == ""


def verifies_result() -> Column:
    return F.col("has_reference") | F.col("has_rows") | F.col("has_value")


def validate_cases(cases: DataFrame) -> DataFrame:
    """Adds ``errors``. Names must be unique within a suite; a hot suite does not hurt, because repeats
    are counted per suite and name."""
    same = (
        cases.groupBy("suite", "case_name").agg(F.count("*").alias("_same")).where(F.col("_same") > 1)
    )
    tolerance, keys = F.col("tolerance"), F.coalesce(F.size("keys"), F.lit(0))
    low, high = fixed.TRIALS
    errors = _errors(
        (_blank("suite") | _blank("agent"), "suite requires a name and an agent"),
        (_blank("case_name") | _blank("question"), "case requires a name and a question"),
        (~F.col("comparison").isin(*fixed.COMPARISONS), "unsupported comparison"),
        (
            F.isnan(tolerance) | (tolerance < 0) | (tolerance == float("inf")),
            "tolerance must be finite and not negative",
        ),
        ((F.col("comparison") == "keyed") & (keys <= 0), "keyed comparison requires keys"),
        (F.coalesce(F.col("row_count") < 0, F.lit(False)), "row_count must not be negative"),
        (~F.col("expected_outcome").isin(*fixed.OUTCOMES), "unsupported outcome"),
        (
            F.col("has_reference") & (F.col("has_rows") | F.col("has_value")),
            "use a reference query or a literal result, not both",
        ),
        (~F.col("kind").isin(*fixed.SUITE_KINDS), "unsupported kind"),
        (~F.col("trials").between(low, high), "trials out of range"),
        (F.col("_same").isNotNull(), "case name is not unique"),
    )
    return cases.join(same, ["suite", "case_name"], "left").withColumn("errors", errors).drop("_same")


def validate_agents(agents: DataFrame) -> DataFrame:
    """Adds ``errors`` to agents ``(agent, description, select, max_rows, timeout_seconds)``."""
    selectors = F.coalesce(F.size("select"), F.lit(-1))
    return agents.withColumn(
        "errors",
        _errors(
            (~F.col("agent").rlike(fixed.AGENT_NAME), "bad name"),
            (_blank("description"), "empty description"),
            (selectors <= 0, "no selector"),
            (
                F.exists(
                    F.coalesce("select", F.array().cast("array<string>")),
                    lambda s: F.coalesce(F.trim(s) == "", F.lit(True)),
                ),
                "blank selector",
            ),
            (F.col("max_rows") < 1, "max_rows must be positive"),
            (F.col("timeout_seconds") < 1, "timeout_seconds must be positive"),
        ),
    )
