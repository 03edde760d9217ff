"""Verification that what an answer claims occurs in the result cells it cites.

Tables, all keyed by ``trace_id``:
``answers(trace_id, question, text, row_count)``, ``claims(trace_id, claim_idx, text)``,
``evidence(trace_id, claim_idx, ev_idx, row_idx, col)`` and
``cells(trace_id, row_idx, col, kind, num, str)``.

Failures are rows ``(trace_id, claim_idx, ord, message)``; a trace may have any number of them, so they
are never gathered into one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.functions.equality import bucket
from plumbline.functions.text import claim_numbers as numbers_of
from plumbline.functions.text import question_numbers, words, words_present


def _same(left: str, right: str, *names: str) -> list[Column]:
    return [F.col(f"{left}.{n}") == F.col(f"{right}.{n}") for n in names]


def check_evidence(evidence: DataFrame, cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Evidence that points outside the rows, or to a column its row does not have."""
    e, c, t = evidence.alias("e"), cells.alias("c"), answers.alias("t")
    lost = e.join(c, _same("e", "c", "trace_id", "row_idx", "col"), "left_anti").alias("e")
    outside = (F.col("e.row_idx") < 0) | (F.col("e.row_idx") >= F.col("t.row_count"))
    message = F.when(
        outside, F.concat(F.lit("Evidence row "), "e.row_idx", F.lit(" does not exist"))
    ).otherwise(
        F.concat(
            F.lit("Evidence column '"), "e.col", F.lit("' does not exist in row "), "e.row_idx"
        )
    )
    return lost.join(t, _same("e", "t", "trace_id")).select(
        "e.trace_id", "e.claim_idx", F.lit(1).alias("ord"), message.alias("message")
    )


def check_claims_cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims without any evidence."""
    return claims.join(
        evidence.select("trace_id", "claim_idx"), ["trace_id", "claim_idx"], "left_anti"
    ).select(
        "trace_id",
        "claim_idx",
        F.lit(0).alias("ord"),
        F.concat(F.lit("Claim has no evidence: "), "text").alias("message"),
    )


def unclaimed_answers(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Answers with text but no claim at all; nothing else is checked for them."""
    return answers.where(F.col("text") != "").join(claims.select("trace_id"), "trace_id", "left_anti")


def claim_numbers(claims: DataFrame) -> DataFrame:
    """Numbers stated by claims: ``(trace_id, claim_idx, num_idx, digits, value, decimals, percent)``."""
    found = claims.select("trace_id", "claim_idx", F.posexplode(numbers_of(F.col("text"))).alias("num_idx", "n"))
    digits = F.col("n.digits")
    return found.select(
        "trace_id",
        "claim_idx",
        "num_idx",
        digits.alias("digits"),
        digits.cast("double").alias("value"),
        F.when(
            F.contains(digits, F.lit(".")), F.length(F.substring_index(digits, ".", -1))
        ).otherwise(0).alias("decimals"),
        F.col("n.percent").alias("percent"),
    )


def cited_cells(evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that evidence points to, with the citing claim."""
    e, c = evidence.alias("e"), cells.alias("c")
    return e.join(c, _same("e", "c", "trace_id", "row_idx", "col")).select(
        "e.trace_id", "e.claim_idx", "c.kind", "c.num", "c.str"
    )


def number_support(numbers: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether each stated number lies within rounding distance of a numeric cell cited in its trace.

    Numbers repeated from the question are dropped. The distance is half a unit of the last decimal;
    a percentage may also match a fraction. Cells are reduced to the least and greatest value per
    bucket somewhat wider than the distance, and a number probes the two or three buckets its
    interval touches: an equi-join with one row per bucket, however many cells a trace cites.
    """
    asked = answers.select("trace_id", question_numbers(F.col("question")).alias("asked"))
    open_numbers = (
        numbers.join(asked, "trace_id", "left")
        .where(~F.coalesce(F.array_contains("asked", F.col("digits")), F.lit(False)))
        .drop("asked")
    )
    reach = F.when(F.col("decimals") > 0, F.lit(0.5) * F.pow(F.lit(10.0), -F.col("decimals"))).otherwise(
        F.lit(fixed.WHOLE_NUMBER_TOLERANCE)
    )

    def distance(level: str) -> Column:
        """Of a level: the number of decimals, negative minus one when read as a percentage."""
        decimals = F.when(F.col(level) >= 0, F.col(level)).otherwise(-F.col(level) - 1)
        base = F.when(decimals > 0, F.lit(0.5) * F.pow(F.lit(10.0), -decimals)).otherwise(
            F.lit(fixed.WHOLE_NUMBER_TOLERANCE)
        )
        return F.when(F.col(level) >= 0, base).otherwise(base / 100) + F.lit(fixed.ROUNDING_SLACK)

    readings = F.array(
        F.struct(
            F.col("value").alias("at"),
            (reach + F.lit(fixed.ROUNDING_SLACK)).alias("reach"),
            F.col("decimals").alias("level"),
        ),
        F.struct(
            (F.col("value") / 100).alias("at"),
            (reach / 100 + F.lit(fixed.ROUNDING_SLACK)).alias("reach"),
            (-F.col("decimals") - 1).alias("level"),
        ),
    )
    readings = F.when(F.col("percent"), readings).otherwise(F.slice(readings, 1, 1))
    read = open_numbers.withColumn("r", F.explode(readings)).select(
        "trace_id", "claim_idx", "num_idx", "value", "r.at", "r.reach", "r.level"
    )
    widened = lambda reach: reach * 1.25
    at, near = F.col("at"), F.col("reach")
    probes = read.withColumn(
        "b",
        F.explode(
            F.array_distinct(
                F.array(*[bucket(x, widened(near)) for x in (at - near, at, at + near)])
            )
        ),
    )
    levels = read.select("trace_id", "level").distinct()
    ranges = (
        cited.where((F.col("kind") == "num") & ~F.isnan("num"))
        .select("trace_id", "num")
        .distinct()
        .join(levels, "trace_id")
        .withColumn("b", bucket(F.col("num"), widened(distance("level"))))
        .groupBy("trace_id", "level", "b")
        .agg(F.min("num").alias("low"), F.max("num").alias("high"))
    )
    hit = F.least(F.abs(at - F.col("low")), F.abs(at - F.col("high"))) <= near
    return (
        probes.join(ranges, ["trace_id", "level", "b"], "left")
        .groupBy("trace_id", "claim_idx", "num_idx")
        .agg(
            F.any_value("value").alias("value"),
            F.bool_or(F.coalesce(hit, F.lit(False))).alias("supported"),
        )
    )


def check_numeric(claims: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """Stated numbers that no cited cell supports, one failure per claim and value."""
    support = number_support(claim_numbers(claims), cited, answers)
    return (
        support.where(~F.col("supported"))
        .select("trace_id", "claim_idx", "value")
        .distinct()
        .select(
            "trace_id",
            "claim_idx",
            F.lit(2).alias("ord"),
            F.concat(F.lit("Numeric claim is absent from cited evidence: "), "value").alias("message"),
        )
    )


def text_support(cited: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether each cited non-blank, non-date text occurs in the answer text."""
    texts = (
        cited.where(
            (F.col("kind") == "str")
            & F.col("str").rlike(r"(?U)\S")
            & ~F.col("str").rlike(fixed.DATE_VALUE)
        )
        .select("trace_id", "claim_idx", "str")
        .distinct()
    )
    said = answers.select("trace_id", words(F.col("text")).alias("said"))
    return texts.join(said, "trace_id").select(
        "trace_id",
        "claim_idx",
        "str",
        words_present(words(F.col("str")), F.col("said")).alias("present"),
    )


def check_text(cited: DataFrame, answers: DataFrame) -> DataFrame:
    return text_support(cited, answers).where(~F.col("present")).select(
        "trace_id",
        "claim_idx",
        F.lit(3).alias("ord"),
        F.concat(F.lit("Text claim is absent from cited evidence: "), "str").alias("message"),
    )


def claim_failures(
    answers: DataFrame, claims: DataFrame, evidence: DataFrame, cells: DataFrame
) -> DataFrame:
    """Every reason why a trace's claims are not supported, as rows."""
    cited = cited_cells(evidence, cells)
    alone = unclaimed_answers(answers, claims).select(
        "trace_id",
        F.lit(-1).alias("claim_idx"),
        F.lit(0).alias("ord"),
        F.lit("Answer text has no evidence-linked claims").alias("message"),
    )
    return (
        check_claims_cited(claims, evidence)
        .unionByName(check_evidence(evidence, cells, answers))
        .unionByName(check_numeric(claims, cited, answers))
        .unionByName(check_text(cited, answers))
        .unionByName(alone)
    )


def _float_text(num: Column) -> Column:
    """A number with at least one decimal and no exponent."""
    plain = F.regexp_replace(num.cast("decimal(38, 12)").cast("string"), "0+$", "")
    return F.when((num == F.floor(num)) & (F.abs(num) < 1e15), F.concat(num.cast("bigint").cast("string"), F.lit(".0"))).otherwise(plain)


def claim_messages(failures: DataFrame) -> DataFrame:
    """All reasons of a trace in one text ``(trace_id, n_failures, message)``, in the order of its claims.

    A claim's unsupported numbers are listed in one reason, so are its absent texts, in ascending order. The text is as long as what the answer
    itself says and cites.
    """
    parts = failures.select(
        "trace_id", "claim_idx", "ord", F.when(F.col("ord") >= 2, F.substring_index("message", ": ", 1)).alias("head"),
        F.when(F.col("ord") >= 2, F.expr("substring(message, instr(message, ': ') + 2)")).otherwise(F.col("message")).alias("item"))
    number = F.when(F.col("ord") == 2, F.col("item").cast("double"))
    listed = parts.groupBy("trace_id", "claim_idx", "ord", "head").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(number.alias("num"), "item"))).alias("items"))
    text = F.when(F.col("head").isNull(), F.array_join(F.transform("items", lambda i: i["item"]), "; ")).otherwise(
        F.concat("head", F.lit(": "), F.array_join(F.transform("items", lambda i: F.coalesce(_float_text(i["num"]), i["item"])), ", ")))
    return listed.groupBy("trace_id").agg(
        F.sum("n").alias("n_failures"), F.sort_array(F.collect_list(F.struct("claim_idx", "ord", text.alias("text")))).alias("all")).select(
        "trace_id", "n_failures", F.array_join(F.transform("all", lambda m: m["text"]), "; ").alias("message"))


def verify_claims(
    answers: DataFrame, claims: DataFrame, evidence: DataFrame, cells: DataFrame
) -> DataFrame:
    """Checks per trace ``(trace_id, ordinal, name, passed, n_failures, message)``; the message tells all failures."""
    failed = claim_messages(claim_failures(answers, claims, evidence, cells))
    claimed = claims.groupBy("trace_id").agg(F.count("*").alias("n_claims"))
    base = (
        answers.select("trace_id", "text", "row_count")
        .join(claimed, "trace_id", "left")
        .join(failed, "trace_id", "left")
    )
    n_claims = F.coalesce("n_claims", F.lit(0))
    n_failures = F.coalesce("n_failures", F.lit(0))
    present = (F.col("row_count") > 0) | (n_claims == 0)
    lone = (n_claims == 0) & (F.col("text") != "")

    def check(ordinal: int, name: str, passed: Column, failures: Column, message: Column) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("name"),
            passed.alias("passed"),
            failures.alias("n_failures"),
            message.alias("message"),
        )

    none = F.lit(0).cast("bigint")
    supported = check(
        1, "claims_supported", n_failures == 0, n_failures, F.coalesce("message", F.lit(""))
    )
    evidence_present = check(
        0,
        "evidence_present",
        present,
        none,
        F.when(present, "").otherwise("No evidence rows returned"),
    )
    static = [
        check(2, "explanation_matches_sql", F.lit(True), none,
              F.lit("Answer was constructed after execution from SQL and evidence")),
    ]
    disclosed = [
        check(3, "date_boundaries_disclosed", F.lit(True), none,
              F.lit("Boundaries are recorded in the interpretation")),
        check(4, "assumptions_disclosed", F.lit(True), none,
              F.lit("Assumptions are recorded in the interpretation")),
    ]
    checks = F.when(lone, F.array(supported, *disclosed)).otherwise(
        F.array(evidence_present, supported, *static, *disclosed)
    )
    return base.select("trace_id", F.explode(checks).alias("c")).select("trace_id", "c.*")


#: Characters of normalised texts.
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _shared_characters(a: Column, b: Column) -> Column:
    """Number of characters that two normalised texts have in common, wherever they stand: no alignment matches more."""
    def count(text: Column, c: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    total = F.lit(0)
    for c in _CHARACTERS:
        total = total + F.least(count(a, c), count(b, c))
    return total


def claim_covered(pairs: DataFrame, claim: str = "claim", context: str = "context") -> DataFrame:
    """Adds ``covered``: does the context say what the claim says?

    Containment either way, or more than half of the claim's weighty words, decide in the JVM. So does the number of characters that both texts
    have, which bounds their similarity from above. Only pairs left undecided are split off, aligned character by character and put back.
    """
    a, b = words(F.col(claim)), words(F.col(context))

    def weighty(text: Column) -> Column:
        kept = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(*fixed.STOP_WORDS))
        aliases = F.create_map(*[F.lit(x) for kv in fixed.WORD_ALIASES.items() for x in kv])
        return F.array_distinct(F.transform(kept, lambda w: F.coalesce(aliases[w], w)))

    ready = pairs.withColumn("_a", a).withColumn("_b", b)
    wa, wb = weighty(F.col("_a")), weighty(F.col("_b"))
    share = F.try_divide(F.size(F.array_intersect(wa, wb)), F.size(wa))
    sure = (
        F.contains("_b", "_a")
        | F.contains("_a", "_b")
        | F.coalesce(share > fixed.SHARED_WORDS, F.lit(False))
    )
    la, lb = F.length("_a"), F.length("_b")
    enough = fixed.SIMILAR * (la + lb)
    near = (2 * F.least(la, lb) >= enough) & (2 * _shared_characters(F.col("_a"), F.col("_b")) >= enough - 1e-9)
    decided = ready.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    decided = decided.withColumn("_open", ~F.col("_sure") & F.coalesce(near, F.lit(False)))
    told = decided.where(~F.col("_open")).withColumn("covered", F.col("_sure"))
    aligned = decided.where("_open").withColumn("covered", _similar("_a", "_b"))
    return told.unionByName(aligned).drop("_a", "_b", "_sure", "_open")


@F.pandas_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    def similar(x: str | None, y: str | None) -> bool:
        if x is None or y is None:
            return False
        m = SequenceMatcher(None, x, y)
        bound = fixed.SIMILAR
        return m.quick_ratio() >= bound and m.ratio() >= bound

    for xs, ys in batches:
        yield pd.Series([similar(x, y) for x, y in zip(xs, ys)], dtype="boolean")
