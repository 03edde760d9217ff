import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from cases import docs, prose

from plumbline.llm import resample as R


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_weights_equal_brute_force_and_the_best_are_taken(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50, 30) if i % 3 else prose(rng, 60, 900)) for i in range(60)] + [(100, None), (101, ""), (None, "w1 w2"), (5, None)]
    marks = [(i, int(i % 3 > 0), int(i == 7)) for i in range(60)] + [(8, 0, 0), (None, 1, 0), (9, None, 0)]
    got = R.resample(docs(spark, rows), labels(spark, marks), share=0.5).collect()
    good = {i for i in range(60) if i % 3 and i not in (7, 8, 9)}
    grams = [R.buckets_of(pa.array([t], pa.string()))[0].tolist() for _, t in rows]
    target, raw = Counter(), Counter()
    for (d, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        target.update(g if d in good else ())
    nt, nr = sum(target.values()) + 2**16, sum(raw.values()) + 2**16
    want = sorted(sum(math.log((target[b] + 1) / nt * nr / (raw[b] + 1)) for b in g) for g in grams)
    assert sorted(r.log_weight for r in got) == pytest.approx(want)
    ordered = sorted(got, key=lambda r: -r.gumbel_key)
    assert [r.selected for r in ordered] == [True] * 32 + [False] * 32


def test_noise_is_gumbel_and_repeats(spark):
    rows = [(i, None) for i in range(4000)]
    a = R.resample(docs(spark, rows), labels(spark, []), share=0.25)
    keys = [r.gumbel_key for r in a.collect()]
    assert abs(sum(keys) / 4000 - 0.5772) < 0.08 and a.where("selected").count() == 1000
    assert sorted(keys) == sorted(r.gumbel_key for r in R.resample(docs(spark, rows[::-1]), labels(spark, []), share=0.25).collect())


def test_edges(spark):
    none = labels(spark, [])
    assert R.resample(docs(spark, []), none).collect() == []
    assert not R.resample(docs(spark, [(1, "a")]), none).first().selected
    assert all(r.selected for r in R.resample(docs(spark, [(1, "a"), (1, "a"), (2, None)]), none, share=1.0).collect())


def test_kth_largest_is_exact(spark):
    rng = random.Random(9)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [5] * 50 + [-(2**63), 2**63 - 1, 0, -1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for k in (1, 2, 77, 130, len(values)):
        assert R.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert R.kth_largest(df, "v", 0) is None and R.kth_largest(df, "v", 10_000) is None
