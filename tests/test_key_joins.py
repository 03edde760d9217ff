"""Joins led by a hash of their keys, and column references that go one way each."""

from __future__ import annotations

from plumbline.functions.variants import relation_key
from plumbline.operators import audit as A
from plumbline.operators import scope as S
from plumbline.operators.joins import hashed_join


def test_hashed_join_is_the_plain_join_and_sorts_by_the_hash(spark):
    left = spark.createDataFrame([("m", "a", 1), ("m", None, 2), (None, "b", 3), ("n", "b", 4)], "d string, u string, x int")
    right = spark.createDataFrame([("m", "a", 10), ("n", "b", 20), (None, "b", 30), ("m", None, 40)], "d string, u string, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = hashed_join(left, right, ["d", "u"], how), left.join(right, ["d", "u"], how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_unqualified_name_counts_over_all_resources_whatever_the_aliases(spark):
    usage = spark.createDataFrame([(1, "", "m", "r1"), (1, "b", "m", "r2")], "query_id long, alias string, manifest_digest string, unique_id string")
    used = spark.createDataFrame([(1, "m", "r1", 1), (1, "m", "r2", 2)], "query_id long, manifest_digest string, unique_id string, ord int")
    known = spark.createDataFrame([("m", "r1", "Id"), ("m", "r2", "id"), ("m", "r2", "size")], "manifest_digest string, unique_id string, column_name string")
    refs = spark.createDataFrame(
        [(1, 1, None, "size"), (1, 2, None, "ID"), (1, 3, "B", "size"), (1, 4, "b", "total"), (1, 5, "x", "id"), (1, 6, None, "total"),
         (1, 7, "cte", "k"), (1, 8, "cte", "z"), (1, 9, None, "gone"), (1, 10, None, "*")],
        "query_id long, ord int, qualifier string, name string")
    derived = spark.createDataFrame([(1, "CTE", "K")], "query_id long, alias string, column_name string")
    aliases = spark.createDataFrame([(1, "total")], "query_id long, name string")
    found = {r.ord: r.status for r in A.resolve_columns(refs, usage, used, derived, aliases, known).collect()}
    assert found == {1: "found", 2: "ambiguous", 3: "found", 4: "missing", 5: "found", 6: "alias", 7: "derived", 8: "derived_missing", 9: "missing"}


def test_relation_key_of_plain_and_unusual_names(spark):
    names = {'"DB".main.A_1': "db.main.a_1", "a..b.": "a.b", ' "a" . [b] ': "a.b", 'x"y': 'x"y', '""."b"': ".b", "": "", "`A`": "a"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.k for r in df.select("n", relation_key(df.n).alias("k")).collect()} == names


def test_join_using_forms_no_pair_of_customer_and_supplier(spark, tmp_path):
    from plumbline.plans.catalog import QUERIES
    from plumbline.plans.registry import TABLES

    supplier = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None), (1, 6)], "s_suppkey long, s_nationkey int")
    customer = spark.createDataFrame([(1, 5, 0.0), (2, 5, 0.0), (3, 6, 0.0), (4, None, 0.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    for name in TABLES:
        (supplier if name == "supplier" else customer).write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["Q02_join_using"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 2), (3, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 2  # customers are counted below the join


def test_rows_are_dealt_out_before_they_are_held(spark, tmp_path):
    spark.range(100).selectExpr("'m' as manifest_digest", "cast(id % 60 as string) as unique_id", "'' as description").write.parquet(str(tmp_path / "c"))
    found = S.undocumented(spark.read.parquet(str(tmp_path / "c")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "HashAggregate" not in plan[plan.index("Exchange"):]  # nothing is gathered below the shuffle
    assert sorted(int(r["unique_id"]) for r in found.collect()) == list(range(60))
