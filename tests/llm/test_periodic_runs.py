import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import docs, prose

from plumbline.llm import periodic_runs as P

SMALL = P.Tiling(words=40, short=8, core=4)


def runs_of(w):
    """Runs by their definition: for every period the stretches that cannot be extended, less those with a smaller period."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def words(text):
    return (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


def texts(rng):
    yield from (None, "", " \n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "ab ab ab ab\tab\x0bab x")
    for _ in range(60):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        yield " ".join(rng.choice(letters) for _ in range(rng.randrange(90)))
    for _ in range(40):  # nested and neighbouring runs
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abcdefxyz"[: rng.randrange(1, 9)]) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33]))]
            parts += (unit * 7)[: len(unit) * rng.randrange(2, 7) + rng.randrange(len(unit))]
        yield " ".join(parts)
    thue = "a"
    for _ in range(8):
        thue += thue.translate(str.maketrans("ab", "ba"))
    yield " ".join(thue)  # no cubes
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield " ".join(fib[-1])
    yield "a " * 700
    yield prose(rng, 120) + " " + " ".join(f"z{i % 75}" for i in range(311)) + " " + prose(rng, 60)


@pytest.mark.parametrize("tiling", [P.Tiling(), SMALL, P.Tiling(words=16, short=8, core=16)])
def test_equals_definition(spark, tiling):
    rows = list(enumerate(texts(random.Random(7)))) + [(None, "b a " * 60), (None, "b a " * 60), (3, "c c c c c c c")]
    got = {(r.doc_id, r.t): [] for r in P.keyed_texts(docs(spark, rows)).withColumnRenamed("id", "doc_id").collect()}
    for r in P.periodic_runs(docs(spark, rows), tiling).collect():
        got[r.id, r.t].append((r.start, r.length, r.period))
    keys = {(r.id, r.t): r.text for r in P.keyed_texts(docs(spark, rows)).collect()}
    for key, text in keys.items():
        assert sorted(got[key]) == runs_of([w for w in words(text) if w]), text


def test_long_random_periods_across_tiles(spark):
    rng = random.Random(8)
    rows = []
    for d in range(25):
        w = []
        while len(w) < 900:
            unit = [str(rng.randrange(rng.choice([2, 50]))) for _ in range(rng.randrange(1, 120))]
            w += prose(rng, rng.randrange(1, 60)).split() + (unit * 9)[: len(unit) * rng.randrange(3, 6) + rng.randrange(len(unit))]
        rows.append((d, " ".join(w)))
    got = {}
    for r in P.periodic_runs(docs(spark, rows), SMALL).collect():
        got.setdefault(r.id, []).append((r.start, r.length, r.period))
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, t in rows if (x := runs_of(t.split()))}


def test_tiles_show_every_run_with_three_periods():
    for n in (1, 39, 200, 777, 5000):
        tiles = list(P.tiles_of(n, SMALL))
        for low, _, _, _ in tiles:
            own = [(a, b) for lo, _, a, b in tiles if lo == low]
            assert own[0][0] == 0 and own[-1][1] == n and all(y[0] < x[1] for x, y in zip(own, own[1:], strict=False))
    assert list(P.tiles_of(100, P.Tiling())) == [(1, 1 << 62, 0, 100)]


def test_one_word_text_is_fast():
    w = np.full(200_000, 7, np.uint64)  # only the periods that are compared shift by shift are seen, no multiple beyond
    assert P.solve(w, np.array([0, len(w)])).tolist() == [[q, 0, 200_000 - q] for q in range(1, P.FIRST)]


def contract(doc_id, text):
    w = [x for x in words(text) if x]
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc_id), len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_contract(spark):
    rng = random.Random(9)
    rows = [(i * 7, t) for i, t in enumerate(texts(rng))] + [(5000 + i, prose(rng, rng.randrange(1, 80), 5)) for i in range(60)] + [(None, "q " * 30), (7, "Z z " * 9)]
    rows += [rows[20], rows[70]]
    got = sorted(str((str(r.doc_id), *list(r)[1:])) for r in P.looped_runs(docs(spark, rows), SMALL).collect())
    assert got == sorted(str(contract(*r)) for r in rows)


def test_empty_table(spark):
    assert P.looped_runs(docs(spark, [])).collect() == []
