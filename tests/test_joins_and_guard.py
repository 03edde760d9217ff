"""Interval joins, the question guard and latency sketches against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import intervals as I
from plumbline.operators import observe as O


def spells(rng, n, span, longest):
    out = []
    for i in range(n):
        low = rng.choice([rng.randrange(span), rng.random() * span, -rng.random() * span])
        length = rng.choice([0, 0, rng.random(), rng.random() * longest, 2.0 ** rng.randrange(-12, 8), -1])
        out.append((i, rng.choice("ab"), float(low), float(low + length)))
    return out + [(n, "a", None, 3.0), (n + 1, "a", 3.0, None), (n + 2, "a", float("nan"), 1.0), (n + 3, None, 0.0, 9.0), (n + 4, "a", 0.0, float("inf"))]


def share_a_point(a, b):
    (al, ah), (bl, bh) = a, b
    if None in (al, ah, bl, bh) or ah < al or bh < bl or al != al or bl != bl or float("inf") in (ah, bh):
        return False
    if al == ah or bl == bh:
        if al == ah and bl == bh:
            return al == bl
        (x, _), (low, high) = (a, b) if al == ah else (b, a)
        return low <= x < high
    return max(al, bl) < min(ah, bh)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_overlaps_equal_brute_force(spark, by):
    rng = random.Random(len(by))
    left, right = spells(rng, 150, 60, 40), spells(rng, 120, 60, 300)
    frames = [spark.createDataFrame(x, "id int, k string, low double, high double") for x in (left, right)]
    got = sorted((r.left.id, r.right.id) for r in I.overlap_join(*frames, by).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if (not by or a[1] == b[1] is not None) and share_a_point(a[2:], b[2:]))
    assert got == want and want
    assert I.overlap_join(frames[0].limit(0), frames[1].limit(0), by).isEmpty()


def test_crowded_buckets_are_dealt_out(spark):
    """Points in windows, spells in spells; with a bound on a bucket's pairs both sides are cut somewhere, and few rows fill many tasks."""
    rng = random.Random(8)
    point = lambda i, x: (i, rng.choice("xy"), x, x)
    points = [point(i, float(rng.randrange(300))) for i in range(150)] + [point(150 + i, 77.0) for i in range(60)]
    windows = [(i, rng.choice("xy"), float(x), x + rng.choice((0.5, 40.0, 60.0))) for i, x in enumerate(rng.choices(range(300), k=40))]
    many = [(40 + i, "x", 70.0 + i / 100, 130.0 + i / 100) for i in range(90)]
    for left, right in ((windows, points), (windows + many, points[:20]), (points, windows), (windows, windows + many)):
        frames = [spark.createDataFrame(x, "id int, k string, low double, high double").withColumn("m", F.create_map("k", "id")) for x in (left, right)]
        want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and share_a_point(a[2:], b[2:]))
        for bound in (20, 10**6):
            met = I.overlap_join(*frames, ["k"], hot_pairs=bound)
            assert sorted((r.left.id, r.right.id) for r in met.collect()) == want and want
        assert met.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_no_nested_loop(spark):
    points = spark.range(1000).selectExpr("id", "double(id) as low", "double(id) as high")
    text = I.overlap_join(points, points.withColumn("high", F.col("low") + 5))._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_guard_equals_a_scan(spark):
    rng = random.Random(3)
    letters = "aab cß"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = [(a, i, word(rng.randrange(1, 7))) for a in "xy" for i in range(40)] + [("x", 99, "ABSENT"), ("y", 98, None), ("z", 1, ""), ("v", 1, "Straße")]
    asked = [(i, rng.choice("xyw"), word(rng.randrange(12)).upper() if i % 2 else word(rng.randrange(12))) for i in range(300)]
    asked += [(300, "x", None), (301, "z", "any"), (302, "z", ""), (303, None, "aa"), (304, "v", "DIE STRASSE."), (305, "v", "Strase"), (3, "x", "a")]
    questions = spark.createDataFrame(asked, "id int, agent string, question string")
    fold = lambda t: t.lower().replace("ß", "ss")
    got = sorted((r.id, str(r.agent), r.blocked_term) for r in A.guard_questions(questions, spark.createDataFrame(terms, "agent string, ord int, term string")).collect())
    want = sorted((i, str(a), min(((o, t) for g, o, t in terms if g == a and t is not None and q is not None and fold(t) in fold(q)), default=(0, None))[1])
                  for i, a, q in asked)
    assert got == want and len({t for _, _, t in want}) > 10
    none = A.guard_questions(questions, spark.createDataFrame([], "agent string, ord int, term string"))
    assert {r.blocked_term for r in none.collect()} == {None}


def test_copies_of_a_term_are_looked_for_once(spark):
    copies = [("x", 1000 - i, ("Straße", "STRASSE", "strasse")[i % 3]) for i in range(500)] + [("y", 7, "strasse"), ("x", 2000, "weg"), ("x", 1, None)]
    terms = spark.createDataFrame(copies, "agent string, ord int, term string")
    assert sorted(tuple(r) for r in A.folded_terms(terms).collect()) == [("x", 501, "STRASSE", "strasse"), ("x", 2000, "weg", "weg"), ("y", 7, "strasse", "strasse")]
    asked = spark.createDataFrame([(1, "x", "Welche Strasse, welcher Weg?"), (2, "y", "Weg")], "id int, agent string, question string")
    assert {r.id: r.blocked_term for r in A.guard_questions(asked, terms).collect()} == {1: "STRASSE", 2: None}


def test_merged_sketches_keep_their_bound(spark):
    runs = spark.range(60_000).select((F.col("id") % 3).alias("agent"), (F.col("id") % 7).alias("day"), (F.rand(4) * F.rand(5) * 1000).alias("latency_ms")).cache()
    odd = spark.createDataFrame([(0, 0, None), (0, 0, float("nan"))], "agent bigint, day bigint, latency_ms double")
    stored = O.latency_sketches(runs.unionByName(odd), "agent", "day")
    told = {r.agent: r for r in O.latency_quantiles(stored, "agent").collect()}
    for agent in range(3):
        exact = sorted(r.latency_ms for r in runs.where(f"agent = {agent}").collect())
        assert told[agent].n_runs == len(exact) == 20_000
        for p in (50, 95, 99):
            rank = sum(x <= told[agent][f"p{p}_latency_ms"] for x in exact) / len(exact)
            assert abs(rank - p / 100) <= 2.3 / 400**0.9
