import random
from collections import defaultdict

import pytest
from cases import docs, lower

from plumbline.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to count as shared text, surely"


def brute(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= least_chars and d is not None:
                holders[key].add(d)
    keep = {k: max(ids) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        lost = [(key := lower(x.strip(WHITE))) in keep and d != keep[key] for x in lines]
        out.append((str(d), "\n".join(x for x, g in zip(lines, lost, strict=True) if not g), len(lines), sum(lost)))
    return sorted(out)


def found(spark, rows, **settings):
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(docs(spark, rows), **settings).collect())


@pytest.mark.parametrize("hot_keys", [10_000, 3, 0])
def test_equals_brute_force(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(L, "HOT_KEYS", hot_keys)  # all by broadcast, some, none
    rng = random.Random(hot_keys)
    shared = [f"{LONG} {i} Ünï" for i in range(12)] + [f"short {i}" for i in range(3)]
    rows = []
    for d in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own line {rng.randrange(10**9)} of a document that is long" for _ in range(rng.randrange(1, 9))]
        lines = [rng.choice([x, x.upper().replace("Ü", "ü"), f" \t{x}\x0b\r", f"\xa0{x}"]) for x in lines]
        rows.append((d if d % 9 else d // 9, "\n".join(lines)))  # ids that repeat
    rows += [(None, rows[0][1]), (None, None), (None, f"{LONG} 0 ünï"), (99, None), (100, ""), (101, "\n\n"), (102, f"{LONG} 1 Ünï\n" * 400), rows[5], rows[5]]
    rows += [(200 + i, f"{LONG} x\n{LONG} x") for i in range(5)] + [(300 + i, "e" * 39 + f"\n{'é' * 40}") for i in range(5)]
    rows += [(400 + i, "a line with a nul \x00 and a control \x1f sign, long") for i in range(5)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_small_thresholds_and_empty_table(spark):
    rows = [(1, "a\nb\na"), (2, "A \nc"), (3, "b")]
    assert found(spark, rows, least_chars=1, least_docs=2) == brute(rows, 1, 2) == [("1", "", 3, 3), ("2", "A \nc", 2, 0), ("3", "b", 1, 0)]
    assert found(spark, []) == []


def test_other_columns_stay_and_clashing_counts_are_replaced(spark):
    rows = spark.createDataFrame([(7, "x\ny", "old", 3, {"k": 1}, "dot")], "doc_id long, text string, n_lines string, pos int, gone map<string,int>, `a.b` string")
    got = L.dedup_lines(rows).first().asDict()
    assert got == {"doc_id": 7, "text": "x\ny", "n_lines": 2, "n_dropped": 0, "pos": 3, "gone": {"k": 1}, "a.b": "dot"}
