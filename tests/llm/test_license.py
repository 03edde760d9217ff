import pytest
from cases import ALNUM, docs, lower

from plumbline.llm.license import TEMPLATES, scan, template_table


def pairs(text):
    w = ALNUM.findall(lower(text))
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(rows, threshold=0.8):
    best: dict = {}
    for d, text in rows:
        for p in {*(text or "").split("\n"), text or ""}:
            for name, t in TEMPLATES:
                a, b = pairs(p), pairs(t)
                dice = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
                if dice >= threshold:
                    best.setdefault((d, name), {})[p] = max(dice, best.get((d, name), {}).get(p, 0))
    return sorted((str(d), n, pytest.approx(max(x.values())), len(x)) for (d, n), x in best.items())


def test_scan_equals_brute_force(spark):
    rows = [(1, "Intro\nLicensed under the APACHE license -- version 2.0\nmore"), (2, TEMPLATES[4][1].replace("and", "\n")), (3, TEMPLATES[4][1]), (4, None), (5, ""),
            (6, "All rights reserved."), (7, "all rights reserved\nAll Rights Reserved!\nall rights are not reserved"), (8, "word " * 50_000), (None, "Released under the MIT License."),
            (9, "MIT License"), (10, TEMPLATES[8][1] + " " + TEMPLATES[10][1]), (6, "All rights reserved.")]
    got = scan(docs(spark, rows), template_table(spark))
    assert sorted((str(r.id), r.license, r.dice, r.n_passages) for r in got.collect()) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_empty_tables(spark):
    assert scan(docs(spark, []), template_table(spark)).collect() == []
    assert scan(docs(spark, [(1, "All rights reserved.")]), template_table(spark).limit(0)).collect() == []


def test_pairs_at_the_border_are_found(spark):
    at = {t: len(pairs(t)) for _, t in TEMPLATES}
    texts = [f"{t} {' '.join(f'x{i}' for i in range(m // 2))}" for t, m in at.items()]  # dice 2m / (m + 1.5m) for even m
    texts += [" ".join(ALNUM.findall(lower(t))[: -(m // 3)]) for t, m in at.items() if m % 3 == 0]  # two thirds of the template
    rows = list(enumerate(texts))
    got = sorted((str(r.id), r.license, r.dice, r.n_passages) for r in scan(docs(spark, rows), template_table(spark)).collect())
    assert got == brute(rows) and sum(r[2] == 0.8 for r in got) >= 3
    made = spark.createDataFrame([(m, str(m), " ".join(f"t{m}x{i}" for i in range(m + 1))) for m in range(2, 41)], "template_id int, license string, template string")
    rows = [(m, " ".join(f"t{m}x{i}" for i in range(m + 1)) + " " + " ".join(f"y{i}" for i in range(m // 2))) for m in range(2, 41, 2)]
    rows += [(100 + m, " ".join(f"t{m}x{i}" for i in range(m * 2 // 3 + 1))) for m in range(3, 41, 3)]
    got = {r.id: r.dice for r in scan(docs(spark, rows), made).collect()}
    assert got == dict.fromkeys([r[0] for r in rows], 0.8)
