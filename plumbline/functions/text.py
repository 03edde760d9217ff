"""Text normalisation, number reading and containment as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed


def fold(text: Column) -> Column:
    """Case-insensitive form; like Python's casefold for the letters met in practice."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_question(text: Column) -> Column:
    """Trimmed, single-spaced and case-folded."""
    return F.trim(fold(F.regexp_replace(text, r"(?U)\s+", " ")))


def words(text: Column) -> Column:
    """Lower-case ``[a-z0-9]+`` tokens, joined by single blanks."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def words_present(value: Column, text: Column) -> Column:
    """Both already normalised by ``words``: several words as a substring, one word as a whole token."""
    return (
        F.when(value == "", True)
        .when(F.contains(value, F.lit(" ")), F.contains(text, value))
        .otherwise(F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), value, F.lit(" "))))
    )


def case_slug(question: Column) -> Column:
    dashed = F.regexp_replace(F.lower(question), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(60))


def claim_numbers(text: Column) -> Column:
    """``array<struct<digits, percent>>`` of the numbers a claim states; dates and plain years are left out."""
    bare = F.regexp_replace(F.regexp_replace(text, fixed.ISO_DATE, ""), fixed.WRITTEN_DATE, "")
    pattern = F.lit(fixed.CLAIM_NUMBER)
    found = F.zip_with(
        F.regexp_extract_all(bare, pattern, F.lit(1)),
        F.regexp_extract_all(bare, pattern, F.lit(2)),
        lambda n, p: F.struct(F.replace(n, F.lit(",")).alias("digits"), (p == "%").alias("percent")),
    )
    return F.filter(found, lambda n: n["percent"] | ~n["digits"].rlike("^[0-9]{4}$"))


def question_numbers(question: Column) -> Column:
    found = F.regexp_extract_all(question, F.lit(fixed.QUESTION_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","))))
