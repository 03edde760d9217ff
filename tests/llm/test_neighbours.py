import numpy as np
import pytest

from plumbline.llm import neighbours as N

SMALL = N.Settings(least_sample=300, list_rows=30, shard_rows=40, query_rows=7, beam=8)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")


def exact(rows, every, k):
    """(query, neighbour) -> cosine, by sorting all cosines of every query in plain Python order."""
    good = [(i, np.array(np.float32(v), float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    m = np.stack([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for (i, _), q in zip(good, m, strict=True):
        if i % every == 0:
            order = sorted(((-c, j) for (j, _), c in zip(good, m @ q, strict=True) if j != i))[:k]
            out |= {(i, j): -c for c, j in order}
    return out


def check_order(got, k):
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(len(v) == k and v == sorted(v) for v in by.values())
    return len(by)


def vectors(kind, n, dims, rng):
    if kind == "gaussian":
        return rng.normal(size=(n, dims))
    centres = rng.normal(size=(n // 20, dims))
    return centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("kind", ["clusters", "gaussian"])
@pytest.mark.parametrize("settings", [N.Settings(), N.Settings(list_rows=15)])
def test_recall_against_brute_force(spark, kind, settings):
    n = 6000  # 60 lists, or 400
    data = vectors(kind, n, 16, np.random.default_rng(1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = N.nearest_neighbours(table(spark, rows), 50, 5, settings).collect()
    want = exact(rows, 50, 5)
    assert len({(r.query_id, r.vec_id) for r in got} & set(want)) >= 0.9 * len(want)
    assert all(abs(want[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got if (r.query_id, r.vec_id) in want)
    assert check_order(got, 5) == n // 50


def test_a_frequent_vector_is_split_and_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors("clusters", 900, 16, rng))]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    got = N.nearest_neighbours(table(spark, rows), 50, 5, SMALL).collect()
    want = exact(rows, 50, 5)
    scores = {}
    for (q, _), c in want.items():
        scores.setdefault(q, []).append(round(c, 9))
    hits = sum(round(r.score, 9) in scores[r.query_id] for r in got)
    assert hits >= 0.9 * len(want) and check_order(got, 5) == 22


def test_ties_few_rows_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (9, [2.0, 0.0]), (4, [3.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]),
            (7, [float("inf"), 1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in N.nearest_neighbours(table(spark, rows), 50, 5, SMALL).collect())
    assert got == [(0, 1, 4, 1.0), (0, 2, 9, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 4, 0.0), (50, 3, 9, 0.0)]
    assert N.nearest_neighbours(table(spark, []), 50).collect() == []
    assert N.nearest_neighbours(table(spark, [(50, [1.0, 2.0])]), 50).collect() == []


def test_graph_search_meets_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c = N.Centroids(N.unit(rng.normal(size=(2000, 8))), 24)
    q = N.unit(rng.normal(size=(50, 8)))
    found, gap = c.search(q, 40)
    true = np.argsort(-(q @ c.points.T), axis=1)[:, :40]
    assert np.mean([len(set(a) & set(b)) / 40 for a, b in zip(found, true, strict=True)]) > 0.95
    assert (np.diff(gap, axis=1) >= 0).all()
    row, lists = c.within(q, N.Reach(3.0, 0.0, 40))  # more than the search keeps: none is cut off
    reach = 9 * (2 - 2 * (q @ c.points.T).max(1))
    assert len(lists) == sum((2 - 2 * (q @ c.points.T) <= reach[:, None] + 1e-9).sum(1)) and len(set(zip(row.tolist(), lists.tolist(), strict=True))) == len(lists)
