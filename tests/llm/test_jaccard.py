import random

import pytest
from cases import docs, lower, prose

from plumbline.llm import jaccard as J
from plumbline.llm.components import components


def shingles(text):
    w = lower(text).replace("\x0b", " ").split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = {d: d for d, _ in rows if d is not None}
    changed = True
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if None not in (rows[i][0], rows[j][0])
             and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) > 0]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted((str(d), len(s), comp.get(d)) for (d, _), s in zip(rows, sets, strict=True))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 7])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(block)
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " \t", "one", "ONE", "one two", "a b c", "A  b\nC", "one two three four"])]
    for g in range(6):
        base = prose(rng, rng.choice([30, 120, 150]))
        rows += [(g * 40 + i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(rng.choice([2, 35]))]
    passage = prose(rng, 20)
    rows += [(500 + i, prose(rng, 15) + " " + passage) for i in range(30)] + [(2000, prose(rng, 20_000))] + [(2001, rows[-1][1])]
    rows += [rows[12], rows[13], (None, rows[12][1])]
    rng.shuffle(rows)
    got = sorted((str(r.id), r.n_shingles, r.component_id) for r in J.jaccard_components(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(docs(spark, [])).collect() == []
    assert J.jaccard_components(docs(spark, [(3, None)])).first().component_id == 3


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (7, 7)]
    rng.shuffle(links)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(20)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
