"""Inputs and brute-force versions shared by the tests of this folder."""

from __future__ import annotations

import re

CLASHING = "doc_id long, text string, id long, n long, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def docs(spark, rows, schema=CLASHING):
    """Rows (doc_id, text[, lang]) with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(r[0], r[1], -1, -2, r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows], schema)


def prose(rng, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
