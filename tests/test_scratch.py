"""Written intermediate tables leave nothing else on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.session import cut, stored


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def left_behind(spark, before):
    """Shuffle files that were not there before; they are deleted by another thread."""
    for _ in range(50):
        if not (left := shuffle_blocks(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_shuffles_of_written_tables_are_deleted(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    for write in (lambda df: stored(df, "rows"), cut):
        before = shuffle_blocks(spark)
        table = write(rows)
        assert not left_behind(spark, before)
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
        assert sorted(map(tuple, rows.join(table, ["k", "n"]).collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_column_references_leave_the_shuffles_of_their_last_step_only(spark):
    """Null query ids and names that no resource has keep their rows; the steps before the last have nothing on disk but their tables."""
    usage = spark.createDataFrame([(1, "a", "m", "r1")], "query_id long, alias string, manifest_digest string, unique_id string")
    used = usage.select("query_id", "manifest_digest", "unique_id", F.lit(1).alias("ord"))
    known = spark.createDataFrame([("m", "r1", "Id"), ("m", "r1", "ID"), ("m", "r1", None)], "manifest_digest string, unique_id string, column_name string")
    refs = spark.createDataFrame(
        [(1, 1, "a", "id"), (1, 2, "A", "gone"), (1, 3, None, "id"), (1, 4, "other", "ID"), (None, 5, None, "id"), (None, 6, "a", "id"), (2, 7, None, "id"), (1, 8, "c", "k")],
        "query_id long, ord int, qualifier string, name string")
    derived = spark.createDataFrame([(1, "C", "K"), (1, "c", "k"), (None, "a", "id")], "query_id long, alias string, column_name string")
    aliases = spark.createDataFrame([(2, "other")], "query_id long, name string")
    before = shuffle_blocks(spark)
    found = A.resolve_columns(refs, usage, used, derived, aliases, known)
    assert not left_behind(spark, before)
    assert {r.ord: r.status for r in found.collect()} == {1: "found", 2: "missing", 3: "found", 4: "found", 5: "missing", 6: "missing", 7: "missing", 8: "derived"}


def test_a_verdict_reads_the_failures_of_each_check_as_a_table(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    statements = spark.createDataFrame([(1, 0, 0, "delete"), (2, 0, 0, "select"), (3, 0, 0, "select"), (4, 0, 0, "select")], "query_id long, ord int, depth int, kind string")
    calls = spark.createDataFrame([(1, 0, "read_csv"), (2, 3, "read_csv"), (2, 2, "nextval"), (2, 5, "read_csv"), (None, 1, "read_csv")], "query_id long, ord int, name string")
    joins = spark.createDataFrame([(2, 1, False, False), (3, 1, False, False)], "query_id long, ord int, has_on boolean, has_using boolean")
    used = spark.createDataFrame([(2, "m", "a", 1), (2, "m", "b", 2), (3, "m", "a", 1), (3, "m", "b", 2)], "query_id long, manifest_digest string, unique_id string, ord int")
    found = A.audit(queries, A.audit_read_only(statements), A.audit_functions(calls), A.audit_joins(used, joins))
    assert {r.query_id: r.failed_check for r in found.collect()} == {1: "read_only", 2: "forbidden_functions", 3: "join_conditions", 4: None}
    assert {r.query_id: r.message for r in found.collect()}[2] == "Function 'nextval' is forbidden"
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") <= 3  # none of the checks' own


def test_tolerant_comparison_leaves_tables_only(spark):
    from plumbline.operators.cells import to_rows
    from plumbline.operators.compare import compare_unordered_tolerant

    rows = [(c, i, float(i % 3), float(i // 3)) for c in range(4) for i in range(9)]
    moved = [(c, i, x + (0.9 if c < 3 else 0.0), y - (0.9 if c < 2 else 0.0) + (5 if c == 1 and i == 4 else 0)) for c, i, x, y in rows]
    a, e = (to_rows(spark.createDataFrame(r, "cmp_id int, place int, x double, y double"), "cmp_id", row_idx="place") for r in (rows, moved))
    before = shuffle_blocks(spark)
    found = compare_unordered_tolerant(a, e, 1.0)
    assert not left_behind(spark, before)
    assert {r.cmp_id: r.passed for r in found.collect()} == {0: True, 1: False, 2: True, 3: True}


def test_groups_meet_at_once_or_in_grid_cells_alike(spark, monkeypatch):
    import random

    from plumbline.operators import matching as M

    dice = random.Random(7)
    rows = [(c, 1, 2, side, dice.randint(0, 3), 1.0, [("x", False, float(dice.randint(0, 4))), ("y", False, float(dice.randint(0, 4)))])
            for c in range(60) for side in (1, -1) for _ in range(5 if c % 2 else 2 + (c % 6 == 0 and side))]
    rows = spark.createDataFrame(rows, "cmp_id int, key_a long, key_b long, side int, row_idx int, tolerance double, free array<struct<col:string,flag:boolean,num:double>>")
    found = []
    for most in (64, 5, 0):
        monkeypatch.setattr(M, "NODES_AT_ONCE", most)
        found.append(sorted(r.cmp_id for r in M.unpaired(rows).collect()))
    assert 0 < len(found[0]) < 60 and found[0] == found[1] == found[2]


def test_columns_whose_buckets_touch_stay_free(spark):
    """Buckets are told by bits of 64 in a row; the borders of rows, negative numbers and numbers beyond whole buckets count too."""
    from plumbline.operators.compare import _separate

    sets = {"apart": [3.0, 5.0, -7.0], "within": [10.0, 11.0], "border": [63.0, 64.0], "negative": [-1.0, 0.0], "far": [63.0, 65.0], "same": [63.0, 63.0],
            "later": [127.0, 128.0], "huge": [1e300, float("inf")], "flags": [True, False], "mixed": [True, 9.0]}
    rows = [(name, 1, i, 1.0, 1, 2, [("x", isinstance(v, bool), float(v))]) for name, values in sets.items() for i, v in enumerate(values)]
    split = spark.createDataFrame(rows, "cmp_id string, side int, row_idx int, tolerance double, key_a long, key_b long, nums array<struct<col:string,flag:boolean,num:double>>")
    free = {r.cmp_id: (len(r.free), r.mixed) for r in _separate(split).collect()}
    assert {name for name, (n, _) in free.items() if n} == {"within", "border", "negative", "later", "huge", "mixed"}
    assert {name for name, (_, mixed) in free.items() if mixed} == {"mixed"}
