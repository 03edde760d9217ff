"""Streams over several triggers, late and repeated rows, and restarts, against their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import runs as L

SCHEMA = "trace_id bigint, agent string, case_name string, question string, passed boolean, latency_ms double, created_at string"


def minute(n):
    return f"2026-03-{1 + n // 1440:02d} {n // 60 % 24:02d}:{n % 60:02d}:00"


def record(i, at):
    return (i, f"a{i % 2}", "c", "q", i % 3 != 0, float(i % 17), minute(at))


def parts():
    """Six files: times out of order by up to 40 minutes, each record up to three times, and a last one that moves the watermark on."""
    rng = random.Random(11)
    rows = sorted(((i, 7 * i // 2) for i in range(180)), key=lambda r: r[1] + rng.randrange(40))
    files = [[] for _ in range(5)]
    for place, (i, at) in enumerate(rows):
        files[place // 36].append(record(i, at))
        if i % 5 == 0:
            files[place // 36].append(record(i, at))
        if i % 7 == 0 and place // 36 < 4 and place % 36 > 30:
            files[place // 36 + 1].append(record(i, at))
    return [*files, [record(999, 5000)]]


def write(spark, rows, folder, name):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    for k, rows in enumerate(parts()):
        write(spark, rows, folder, k)
    return folder


JOBS = {
    "once": lambda r: L.drop_repeats(r, "1 hour").select("trace_id", "agent", "created_at"),
    "tumbling": lambda r: L.pass_rate_windows(L.drop_repeats(r, "1 hour"), "30 minutes", delay="1 hour"),
    "sliding": lambda r: L.pass_rate_windows(L.drop_repeats(r, "1 hour"), "1 hour", "20 minutes", "1 hour"),
    "sessions": lambda r: L.activity_sessions(L.drop_repeats(r, "1 hour"), "6 minutes", "1 hour"),
}


def twin(name, rows):
    """The same over the finished log, in plain Python; what the watermark has not closed is left out."""
    once = {r[0]: r for r in rows if r[0] != 999}.values()
    at = lambda r: int(r[6][8:10]) * 1440 - 1440 + int(r[6][11:13]) * 60 + int(r[6][14:16])
    if name == "once":
        return sorted([(r[0], r[1], r[6]) for r in once] + [(999, "a1", minute(5000))])
    if name == "sessions":
        out = []
        for agent in ("a0", "a1"):
            spell = []
            for t in [*sorted(at(r) for r in once if r[1] == agent), 10**9]:
                if spell and t >= spell[-1] + 6:
                    out.append((minute(spell[0]), minute(spell[-1] + 6), agent, len(spell)))
                    spell = []
                spell.append(t)
        return sorted(out)
    width, slide = (30, 30) if name == "tumbling" else (60, 20)
    groups = {}
    for r in once:
        for start in range((at(r) - width) // slide * slide + slide, at(r) + 1, slide):
            groups.setdefault((start, r[1]), []).append(r)
    return sorted((stamp(s), stamp(s + width), a, len(g), sum(r[4] for r in g), max(r[5] for r in g)) for (s, a), g in groups.items())


def stamp(n):
    return minute(n) if n >= 0 else f"2026-02-28 {(n + 1440) // 60:02d}:{(n + 1440) % 60:02d}:00"


def plain(df):
    shown = df.select(*[F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema])
    return sorted(tuple(r) for r in shown.collect())


@pytest.mark.parametrize("name", JOBS)
@pytest.mark.parametrize("files", [1, 2, 1000])
def test_triggers_make_no_difference(spark, log, name, files):
    stream = L.run_stream(spark, f"{log}/*", files_per_trigger=files)
    assert plain(L.run_available(JOBS[name](stream), name)) == twin(name, [r for p in parts() for r in p])


@pytest.mark.parametrize("name", ["once", "tumbling", "sessions"])
def test_a_restart_goes_on_with_its_state(spark, tmp_path, name):
    at = (str(tmp_path / "out"), str(tmp_path / "progress"))
    files = parts()
    for k, rows in enumerate(files):  # a new run for each file: the state of open windows and of seen ids comes from the checkpoint
        write(spark, rows, tmp_path / "log", k)
        found = L.run_available(JOBS[name](L.run_stream(spark, f"{tmp_path}/log/*")), name, at=at)
    assert plain(found) == twin(name, [r for p in files for r in p])


def test_late_rows_are_left_out(spark, tmp_path):
    for k, rows in enumerate([[record(1, 600)], [record(2, 1000)], [record(4, 1000)], [record(3, 601)], [record(999, 5000)]]):
        write(spark, rows, tmp_path, k)
    found = L.run_available(L.pass_rate_windows(L.run_stream(spark, f"{tmp_path}/*", files_per_trigger=1), "30 minutes", delay="1 hour"), "late")
    assert {(r.agent, r.n_runs) for r in found.collect()} == {("a1", 1), ("a0", 2)}  # the one before the last came when its window was told
