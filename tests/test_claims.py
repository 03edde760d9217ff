"""Golden claims, coverage pairs, and number support against brute force."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import case_slug, normalize_question, words, words_present
from plumbline.operators import claims as V

CELLS = "trace_id int, row_idx int, col string, kind string, num double, str string"


def tables(spark, items):
    """Items: (answer text, question, claims [(text, [(row, col)])], rows [dict])."""
    answers, claims, evidence, cells = [], [], [], []
    for t, (text, question, stated, rows) in enumerate(items):
        answers.append((t, question, text, len(rows)))
        for c, (claim, cited) in enumerate(stated):
            claims.append((t, c, claim))
            evidence += [(t, c, i, r, col) for i, (r, col) in enumerate(cited)]
        for i, row in enumerate(rows):
            for col, v in row.items():
                if isinstance(v, (int, float)):
                    cells.append((t, i, col, "num", float(v), None))
                else:
                    kind = "temporal" if v.startswith("date:") else "str"
                    cells.append((t, i, col, kind, None, v.removeprefix("date:")))
    return (
        spark.createDataFrame(answers, "trace_id int, question string, text string, row_count int"),
        spark.createDataFrame(claims, "trace_id int, claim_idx int, text string"),
        spark.createDataFrame(evidence, "trace_id int, claim_idx int, ev_idx int, row_idx int, col string"),
        spark.createDataFrame(cells, CELLS),
    )


def one(text, cited, row, question=""):
    return (text, question, [(text, [(0, c) for c in cited])], [row])


GOLDEN = [
    (one("During 2024, Harbour Lane Depot shipped 412 crates.", ["depot", "crates"],
         {"depot": "Harbour Lane Depot", "crates": 412}), True),
    (one("Mean weight is 7.45 and the spoilage share is 12.9%.", ["weight", "spoilage"],
         {"weight": 7.4512, "spoilage": 0.1288}), True),
    (one("Late arrivals came to 8.31%.", ["late_pct"], {"late_pct": 8.3067}), True),
    (one("Of routes with 30 stops or more, the lowest cost was 0.275.", ["cost"], {"cost": 0.275},
         "Which is cheapest among routes with 30 stops or more?"), True),
    (one("Readings run from 2019-03-04 to 2025-11-30.", ["a", "b"],
         {"a": "date:2019-03-04", "b": "date:2025-11-30"}), True),
    (one("The inspection took place on May 9, 2025.", ["d"], {"d": "date:2025-05-09"}), True),
    (one("Freight cost $77.60.", ["freight"], {"freight": 77.6}), True),
    (one("Freight cost $512.00.", ["freight"], {"freight": 77.6}), False),
    (one("Northgate came first.", ["site"], {"site": "Southfield"}), False),
    (one("Freight was 8.", ["missing"], {"v": 8}), False),
    (("No source gives 8.", "", [("No source gives 8.", [])], [{"v": 8}]), False),
    (("Words without a claim.", "", [], [{"v": 8}]), False),
    (("", "", [], []), True),
]


def test_golden_claims(spark):
    t = tables(spark, [g for g, _ in GOLDEN])
    checks = V.verify_claims(*t).where("name = 'claims_supported'").collect()
    got = {r.trace_id: r.passed for r in checks}
    assert got == {i: ok for i, (_, ok) in enumerate(GOLDEN)}
    messages = {r.trace_id: r.message for r in checks}
    assert "512.0" in messages[7]
    assert messages[9].startswith("Evidence column 'missing'") and messages[11].startswith("Answer text has no")


def test_number_support_equals_brute_force(spark):
    rng = random.Random(11)
    items, want = [], {}
    for t in range(80):
        row = {f"c{i}": round(rng.uniform(-20, 20), rng.randint(0, 4)) for i in range(4)}
        texts = []
        for _ in range(3):
            base = rng.choice(list(row.values())) * rng.choice([1, 1, 100])
            decimals = rng.randint(0, 3)
            texts.append((f"{base + rng.choice([0, 0, 0.004, 0.6]):.{decimals}f}", rng.random() < 0.4))
        claim = " and ".join(f"x {n}{'%' if p else ''}" for n, p in texts) + " end"
        items.append(one(claim, list(row), row))
        for n, percent in texts:
            if re.fullmatch(r"\d{4}", n) and not percent:  # a year
                continue
            # exact arithmetic: a cell supports a number that it rounds to, as it is or as a share of 100
            half = Fraction(1, 2 * 10 ** len(n.partition(".")[2])) if "." in n else Fraction(1, 10**9)
            slack = Fraction(1, 10**12)
            inside = [abs(Fraction(str(v)) * scale - Fraction(n)) <= half + scale * slack
                      for v in row.values() for scale in ((1, 100) if percent else (1,))]
            want[(t, float(n))] = want.get((t, float(n)), True) and any(inside)
    answers, claims, evidence, cells = tables(spark, items)
    support = V.number_support(V.claim_numbers(claims), V.cited_cells(evidence, cells), answers)
    got = {}
    for r in support.collect():
        got[(r.trace_id, r.value)] = got.get((r.trace_id, r.value), True) and r.supported
    assert got == want and {True, False} <= set(want.values())


@pytest.mark.parametrize(
    ("claim", "context", "covered"),
    [
        ("The depot at Harbour Lane shipped the most crates, 412 in all.", "Harbour Lane depot shipped the most crates, 412 in all.", True),
        ("During 2024, Harbour Lane shipped the most crates with 412 crates.",
         "Harbour Lane shipped the most crates during 2024. That was 412 crates.", True),
        ("Harbour Lane shipped 412 crates.", "Northgate lost 95 pallets.", False),
        ("abcdefghijklmnopqrst uvw", "abcdefghijklmnopqrst uvx", True),
    ],
)
def test_claim_coverage(spark, claim, context, covered):
    df = spark.createDataFrame([(claim, context)], "claim string, context string")
    assert V.claim_covered(df).first().covered is covered


def test_coverage_equals_brute_force(spark):
    from difflib import SequenceMatcher

    from plumbline.functions import fixed

    rng = random.Random(12)
    word = lambda: rng.choice(["the", "was", "won", "games", "wins", "crate", "harbour", "9", "x" * rng.randrange(1, 6), f"w{rng.randrange(40)}"])
    pairs = []
    for i in range(250):
        claim = " ".join(word() for _ in range(rng.randrange(0, 9)))
        letters = list(claim)
        for _ in range(rng.randrange(5)):
            if letters:
                letters[rng.randrange(len(letters))] = rng.choice("aeiou 1-")
        context = rng.choice(["".join(letters), "".join(rng.sample(claim, len(claim))), " ".join(word() for _ in range(rng.randrange(0, 9)))])
        pairs.append((i, claim, context))
    tokens = lambda t: {fixed.WORD_ALIASES.get(w, w) for w in t.split() if w not in fixed.STOP_WORDS}
    want, aligned = {}, 0
    for i, claim, context in pairs:
        a, b = (" ".join(re.findall("[a-z0-9]+", t.lower())) for t in (claim, context))
        sure = a in b or b in a or bool(tokens(a)) and len(tokens(a) & tokens(b)) / len(tokens(a)) > 0.5
        want[i] = sure or SequenceMatcher(None, a, b).ratio() >= 0.9
        aligned += want[i] and not sure
    got = {r.i: r.covered for r in V.claim_covered(spark.createDataFrame(pairs, "i int, claim string, context string")).collect()}
    assert got == want and aligned and set(want.values()) == {True, False}


def test_all_failures_are_told_in_order(spark):
    rows = [(1, 1, 2, "Numeric claim is absent from cited evidence: 12.5"), (1, 1, 2, "Numeric claim is absent from cited evidence: 3.0"),
            (1, 1, 2, "Numeric claim is absent from cited evidence: 1.2E8"), (1, 0, 0, "Claim has no evidence: x: y"), (1, 1, 3, "Text claim is absent from cited evidence: b: c"),
            (1, 1, 3, "Text claim is absent from cited evidence: a"), (2, -1, 0, "Answer text has no evidence-linked claims")]
    found = {r.trace_id: (r.n_failures, r.message) for r in V.claim_messages(spark.createDataFrame(rows, "trace_id int, claim_idx int, ord int, message string")).collect()}
    assert found == {1: (6, "Claim has no evidence: x: y; Numeric claim is absent from cited evidence: 3.0, 12.5, 120000000.0; "
                            "Text claim is absent from cited evidence: a, b: c"), 2: (1, "Answer text has no evidence-linked claims")}


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("Harbour Lane Depot", "At Harbour Lane Depot they shipped 412 crates."),
         ("Old Mill Yard", "The New Mill Yard shipped 412 crates."), ("--", "x"), ("ill", "mill won")],
        "v string, t string")
    got = [r.p for r in df.select(words_present(words(F.col("v")), words(F.col("t"))).alias("p")).collect()]
    assert got == [True, False, True, False]
    row = spark.sql("select '  Straße \t IS here ' q, '  What? -- Now!' s").select(
        normalize_question(F.col("q")).alias("q"), case_slug(F.col("s")).alias("s")).first()
    assert (row.q, row.s) == ("strasse is here", "what-now")
