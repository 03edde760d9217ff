"""Artifacts to tables, selectors, lineage, history, audit and governed queries on a small ferry company."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import history as H
from plumbline.operators import resources as N
from plumbline.operators import scope as S
from plumbline.plans.governed import QueryRejected, Relation, fetch, governed_query, save
from plumbline.sources import artifacts

CROSSINGS = [("Aurora", 11, 310, "Kalmar"), ("Borealis", 12, 95, "Visby"), ("Aurora", 14, 47, "Visby"), ("Corvus", 14, 0, None)]


def node(name, folder="deck", **extra):
    return {"resource_type": "model", "package_name": "ferry", "name": name, "alias": name, "database": "sea", "schema": "pub",
            "relation_name": f'"sea"."pub"."{name}"', "original_file_path": f"models/{folder}/{name}.sql",
            "config": {"materialized": "table"}, "columns": {}, **extra}


def described(**columns):
    return {c: {"name": c, "description": d} for c, d in columns.items()}


NODES = {
    "model.ferry.crossings": node(
        "crossings", "bridge", access="private", checksum={"checksum": "0f" * 32}, constraints=[{"type": "unique"}],
        config={"materialized": "incremental", "group": "traffic", "tags": ["daily", "public"]}, depends_on={"nodes": ["model.ferry.legs"]},
        columns=described(vessel="Name on the hull.", day="", passengers="", port=""), description="Crossings,\n\t one a row  "),
    "model.ferry.legs": node("legs", "hold", columns=described(vessel="", port="Where the vessel lands."), depends_on={"nodes": ["source.ferry.radio.pings"]}),
    "model.ferry.crossings_old": node("crossings_old", alias="crossings", schema="attic", relation_name='"sea"."attic"."crossings"'),
    "model.ferry.wreck": node("wreck", config={"enabled": False}),
    "model.ferry.foam": node("foam", config={"materialized": "ephemeral"}),
    "model.tides.moon": node("moon", package_name="tides"),
    "test.ferry.day_known": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.ferry.crossings"]},
                             "test_metadata": {"name": "not_null", "kwargs": {"column_name": "day"}}},
}
FIRST = {
    "metadata": {"dbt_schema_version": "v12", "dbt_version": "1.10"},
    "groups": {"x": {"name": "traffic", "owner": {"name": "Harbour Office"}}},
    "nodes": NODES,
    "sources": {"source.ferry.radio.pings": {"resource_type": "source", "package_name": "ferry", "name": "pings", "identifier": "pings_raw", "schema": "radio"}},
}
# Later the table of crossings is called trips and its ports are sensitive; the moon is gone.
LATER = {**FIRST, "nodes": {
    **{k: v for k, v in NODES.items() if k != "model.tides.moon"},
    "model.ferry.crossings": {**NODES["model.ferry.crossings"], "name": "trips", "alias": "trips", "relation_name": '"sea"."pub"."trips"',
                              "config": {"materialized": "table", "meta": {"sensitive_columns": ["port"]}}}}}
CATALOG = {"nodes": {"model.ferry.crossings": {"stats": {"bytes": {"value": 512}}, "columns": {"PASSENGERS": {"name": "PASSENGERS", "type": "SMALLINT"}, "crew": {"type": "TINYINT"}}},
                     "model.ferry.ghost": {"columns": {"x": {"type": "INT"}}}}}


@pytest.fixture(scope="module")
def company(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("artifacts")
    for name, text in (("first", json.dumps(FIRST)), ("later", json.dumps(LATER)), ("torn", '{"nodes": {')):
        (folder / f"{name}.json").write_text(text)
    docs = artifacts.read_artifacts(spark, str(folder), "*.json").cache()
    problems = {r.key.rsplit("/", 1)[-1]: r.problem for r in docs.collect()}
    assert problems == {"first.json": None, "later.json": None, "torn.json": "invalid JSON"}

    def tables(name):
        m = artifacts.manifests(docs.where(F.col("key").endswith(f"{name}.json")))
        raw = N.resources_raw(m)
        res = N.with_owner(N.normalize_resources(raw), N.groups(m))
        return {"m": m, "raw": raw, "res": res.cache(), "edges": N.edges(m, raw).cache(), "cols": N.columns(raw).cache(),
                "digest": m.first().manifest_digest}

    return {"first": tables("first"), "later": tables("later")}


@pytest.fixture(scope="module")
def now(company):
    return company["first"]


def both(company, part):
    return company["first"][part].unionByName(company["later"][part])


def ids(df):
    return {r.unique_id for r in df.select("unique_id").collect()}


def chosen(spark, now, include=(), exclude=(), parents=False, children=False):
    agents = spark.createDataFrame([("mate", parents, children)], "agent string, include_parents boolean, include_children boolean")
    rows = [("mate", s, False) for s in include] + [("mate", s, True) for s in exclude]
    selectors = spark.createDataFrame(rows, "agent string, selector string, is_exclude boolean")
    return S.resolve_scope(agents, selectors, now["res"], now["edges"])


def test_metadata_is_normalised(now):
    r = now["res"].where("unique_id = 'model.ferry.crossings'").first()
    assert (r.grp, sorted(r.tags), r.owner, r.access, r.materialized) == ("traffic", ["daily", "public"], "Harbour Office", "private", "incremental")
    assert (r.description, len(r.checksum), len(r.constraints)) == ("Crossings, one a row", 64, 1)
    assert ids(now["res"].where("not queryable")) == {"model.ferry.wreck", "model.ferry.foam"}
    facets = {(x.facet, x["value"]): x.n_resources for x in N.summary(now["res"]).collect()}
    assert facets[("model_count", "")] == 4 and ("group", "traffic") in facets and ("path", "models/bridge") in facets
    assert N.tests(now["raw"], now["res"].limit(0)).isEmpty()
    t = N.tests(now["raw"], now["res"]).first()
    assert (t.name, t.column_name, t.target_id) == ("not_null", "day", "model.ferry.crossings")


def test_catalog_only_enriches(spark, now):
    docs = artifacts.parse_documents(spark.createDataFrame([(1, json.dumps(CATALOG))], "id int, text string"), "id")
    physical = N.catalog_columns(docs.select(F.lit(now["digest"]).alias("manifest_digest"), "doc"))
    found = N.enrich_catalog(now["cols"], physical, now["res"])
    whole = N.catalog_statistics(docs.select(F.lit(now["digest"]).alias("manifest_digest"), "doc"), now["res"]).collect()
    assert [(r.unique_id, list(r.statistics)) for r in whole] == [("model.ferry.crossings", ["bytes"])]
    types = {r.column_name: (r.physical_type, r.data_type) for r in found.where("unique_id = 'model.ferry.crossings'").collect()}
    assert types["passengers"][0] == "SMALLINT" and types["crew"][1] == "TINYINT" and "model.ferry.ghost" not in ids(found)


@pytest.mark.parametrize(("selector", "reached"), [
    ("group:traffic", "model.ferry.crossings"), ("tag:public", "model.ferry.crossings"), ("model:legs", "model.ferry.legs"),
    ("source:radio.pings", "source.ferry.radio.pings"), ("path:models/hold", "model.ferry.legs"), ("package:tides", "model.tides.moon")])
def test_selectors(spark, now, selector, reached):
    sel = spark.createDataFrame([("mate", selector, False)], "agent string, selector string, is_exclude boolean")
    assert reached in ids(S.match_selectors(now["res"], sel))
    known = spark.createDataFrame([("mate", now["digest"])], "agent string, manifest_digest string")
    assert S.unmatched_selectors(now["res"], sel, known).isEmpty()


def test_exclusion_and_lineage(spark, now):
    assert chosen(spark, now, ["group:traffic"], ["tag:daily"]).isEmpty()
    assert ids(chosen(spark, now, ["tag:daily"], parents=True)) == {"model.ferry.crossings", "model.ferry.legs"}
    assert ids(chosen(spark, now, ["path:models/hold"], parents=True)) == {"model.ferry.legs"}  # lineage grants no source
    assert ids(chosen(spark, now, ["path:models/hold"], children=True)) == {"model.ferry.crossings", "model.ferry.legs"}


def test_closure_ends_on_cycles(spark):
    ring = [("d", str(i), str((i + 1) % 5), True) for i in range(5)]
    edges = spark.createDataFrame(ring, "manifest_digest string, parent_id string, child_id string, declared boolean")
    starts = spark.createDataFrame([("s", "d", "3")], "start string, manifest_digest string, unique_id string")
    assert ids(S.closure(edges, starts, "down")) == set("01234") == ids(S.closure(edges, starts, "up"))


@pytest.mark.parametrize("direction", ["up", "down"])
def test_reachability_equals_a_walk(spark, direction):
    rng = random.Random(5)
    edges = {(d, rng.randrange(60), rng.randrange(60)) for d in "mn" for _ in range(90)}
    sets = [(i % 90 if i % 13 else None, rng.choice("mn"), rng.randrange(60)) for i in range(200)]  # more sets than one word has bits
    table = spark.createDataFrame([(d, str(a), str(b), True) for d, a, b in edges], "manifest_digest string, parent_id string, child_id string, declared boolean")
    starts = spark.createDataFrame([(k, d, str(v)) for k, d, v in sets], "start int, manifest_digest string, unique_id string")
    want = set()
    for k, d, v in sets:
        seen, todo = set(), [v]
        while todo:
            x = todo.pop()
            for g, a, b in edges:
                y = (b if direction == "down" else a) if g == d and x == (a if direction == "down" else b) else None
                if y is not None and y not in seen:
                    seen.add(y)
                    todo.append(y)
        want |= {(str(k), d, str(y)) for y in seen}
    got = [(str(r.start), r.manifest_digest, r.unique_id) for r in S.closure(table, starts, direction).collect()]
    assert set(got) == want and len(got) == len(want)
    assert S.closure(table.limit(0), starts, direction).isEmpty() and S.closure(table, starts.limit(0), direction).isEmpty()


def test_inherited_descriptions(now):
    bare = S.undocumented(now["cols"])
    assert bare.count() == 2
    up = S.ancestors(bare, now["edges"], now["res"])
    got = {(r.unique_id, r.column_name): r.description for r in S.inherit_descriptions(now["cols"], up).collect()}
    assert got == {("model.ferry.crossings", "port"): "Where the vessel lands."}


def test_names_belong_to_a_snapshot(spark, company):
    first, later = company["first"]["digest"], company["later"]["digest"]
    catalog = both(company, "res")
    scopes = catalog.where("queryable").select(F.lit("mate").alias("agent"), "manifest_digest", "unique_id")
    asked = [(1, first, "crossings"), (2, first, "PUB.Crossings"), (3, first, '"sea"."attic"."crossings"'), (4, first, "trips"),
             (5, later, "crossings"), (6, later, "trips"), (7, later, "moon"), (8, first, "moon"), (9, None, "moon")]
    refs = spark.createDataFrame([(q, 1, "mate", d, r) for q, d, r in asked], "query_id int, ord int, agent string, manifest_digest string, ref string")
    got = {r.query_id: r.unique_id or r.status for r in S.resolve_relations(refs, S.relation_keys(scopes, catalog)).collect()}
    assert got == {1: "ambiguous", 2: "model.ferry.crossings", 3: "model.ferry.crossings_old", 4: "out_of_scope", 5: "model.ferry.crossings_old",
                   6: "model.ferry.crossings", 7: "out_of_scope", 8: "model.tides.moon", 9: "out_of_scope"}
    twins = S.duplicate_aliases(scopes, catalog)
    assert ids(twins) == {"model.ferry.crossings", "model.ferry.crossings_old"} and {r.manifest_digest for r in twins.collect()} == {first}

    known = spark.createDataFrame([("mate", first), ("mate", later)], "agent string, manifest_digest string")
    sel = spark.createDataFrame([("mate", "package:tides", False), ("mate", "hull:red", False)], "agent string, selector string, is_exclude boolean")
    lost = {(r.selector, r.manifest_digest) for r in S.unmatched_selectors(catalog, sel, known).collect()}
    assert lost == {("package:tides", later), ("hull:red", None)}
    sizes = {r.manifest_digest: r.n_resources for r in S.agent_sizes(known.select("agent").distinct(), scopes, known).collect()}
    assert sizes == {first: 5, later: 4}

    usage = spark.createDataFrame([(1, first, "model.ferry.crossings", 1), (2, later, "model.ferry.crossings", 1)],
                                  "query_id int, manifest_digest string, unique_id string, ord int")
    queries = usage.select("query_id", F.lit("mate").alias("agent"))
    names = queries.select("query_id", F.lit("PORT").alias("name"))
    allow = queries.select("agent", F.lit("none").alias("item"))
    hidden = A.sensitive_columns(catalog, both(company, "cols").withColumn("meta", F.expr("cast(null as map<string, variant>)")))
    assert [r.query_id for r in A.audit_sensitive_columns(usage, names, queries, hidden, allow).collect()] == [2]


def test_reference_templates(spark, company):
    first, later = company["first"]["digest"], company["later"]["digest"]
    texts = [(1, first, "select day from {{ ref('crossings') }} c"), (2, later, "select day from {{ ref('crossings') }} c"),
             (3, later, "select 1 from {{ref(\"trips\")}}"), (4, first, "{{ ref('wreck') }}"), (5, first, "{{ env('HOME') }}")]
    t = spark.createDataFrame(texts, "template_id int, manifest_digest string, text string")
    got = {r.template_id: (r.rendered, r.problem) for r in A.render_refs(t, both(company, "res")).collect()}
    assert got[1] == ('select day from "sea"."pub"."crossings" c', None) and got[3] == ('select 1 from "sea"."pub"."trips"', None)
    assert got[2] == (None, "ref('crossings') is ambiguous") and got[4][1] == "ref('wreck') is ambiguous" and got[5][1].startswith("Only ref()")


@pytest.mark.parametrize("slot_seconds", [86_400, 3, 10**9])
def test_as_of_equals_a_scan(spark, slot_seconds):
    rng = random.Random(slot_seconds)
    moment = lambda n: None if rng.random() < 0.05 else rng.randrange(n)
    log = [(i, rng.choice("abc"), moment(200)) for i in range(400)] + [(400, None, 5), (401, "d", 7)]
    told = [(rng.choice("ab"), moment(200), str(i)) for i in range(25)] + [("a", 50, "x"), ("a", 50, "y"), ("d", 8, "z")]
    left = spark.createDataFrame(log, "id int, k string, s int").selectExpr("id", "k", "timestamp_seconds(s) as at")
    right = spark.createDataFrame(told, "k string, s int, v string").selectExpr("k", "timestamp_seconds(s) as since", "v")
    got = {r.id: r.v for r in H.as_of(left, right, ["k"], "at", "since", ["v"], slot_seconds).collect()}
    assert got == {i: max([(s, v) for key, s, v in told if key == k and s is not None and at is not None and s <= at], default=(0, None))[1] for i, k, at in log}
    assert H.as_of(left.limit(0), right, ["k"], "at", "since", ["v"]).isEmpty()
    assert {r.v for r in H.as_of(left, right.limit(0), ["k"], "at", "since", ["v"]).collect()} == {None}


def test_the_first_failure_goes_by_check_then_place(spark):
    failures = [(1, 5, 9, "columns_exist", "a"), (1, 2, 7, "resources_in_scope", "z"), (1, 2, 8, "resources_in_scope", "b"), (2, 6, 3, "sensitive_access", "c")]
    found = spark.createDataFrame(failures, "query_id int, ordinal int, pos long, check string, message string")
    got = {r.query_id: (r.passed, r.failed_check, r.message) for r in A.audit(spark.range(1, 4).selectExpr("int(id) as query_id"), found).collect()}
    assert got == {1: (False, "resources_in_scope", "z"), 2: (False, "sensitive_access", "c"), 3: (True, None, None)}


def crossings(session):
    return session.createDataFrame(CROSSINGS, "vessel string, day int, passengers int, port string")


SCOPE = {"crossings": Relation(crossings, hidden=("port",)), "legs": Relation(crossings)}


def test_governed_query_answers(spark, tmp_path):
    def ask(sql, most=1000, **more):
        return governed_query(spark, SCOPE, sql, most, **more)

    assert fetch(ask("select sum(passengers) as n from crossings where day between 11 and 12"), 60)[0].n == 405
    for sql in ("with c as (select max(day) as d from crossings) select c.d from c", "select q.d from (select max(day) as d from crossings) q",
                "select max(d) as d from (select day as d from crossings union all select day from legs)",
                "select c.day as d from crossings c where c.day = (select max(day) from legs) limit 1",
                "select x.day as d from crossings x join legs y using (vessel, day) where x.day > 12 and 'drop table (legs)' <> x.vessel limit 1"):
        assert ask(sql).first().d == 14
    assert ask("select * from crossings", 3).count() == 3
    assert ask("select * from crossings").columns == ["vessel", "day", "passengers"]
    assert "port" in ask("select * from crossings", allow=["PORT"]).columns
    assert ask("select vessel, k from crossings lateral view explode(array(1, 2)) e as k").count() == 8
    save(ask("select * from crossings", None), str(tmp_path / "out"), 60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_a_saved_query_stops_in_time(spark, tmp_path):
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda b: (__import__("time").sleep(8) or x for x in b), "id long")
    with pytest.raises(TimeoutError):
        save(slow, str(tmp_path / "late"), 1)
    assert not (tmp_path / "late" / "_SUCCESS").exists()


@pytest.mark.parametrize(("sql", "why"), [
    ("truncate table crossings", ""), ("select * from lighthouses", "lighthouses"), ("select depth from crossings", "depth"),
    ("select * from crossings; select 2", ""), ("select port from crossings", "port"), ("select 2 as two", "at least one relation"),
    ("select day from crossings a join legs b on a.day = b.day", "day"), ("drop view legs", ""),
    ("select java_method('java.util.UUID', 'randomUUID') from crossings", "java_method"),
    ("select * from crossings where reflect('java.lang.Math', 'abs', -1) = '1'", "reflect"),
    ("select * from parquet.`/root/testdata/sf0.001/orders.parquet`", ""), ("insert into crossings select * from legs", ""),
    ("select * from crossings) union all (select 3", ""), ("with crossings as (select 5 as z) select * from crossings", "at least one relation"),
    ("select * from (select 7 as z) crossings", "at least one relation"), ("select crossings.id from range(3) crossings", "range"),
    ("select a.day from crossings a cross join legs b", "join condition"), ("select a.day from crossings a, legs b", ""),
    ("select a.day from crossings a, lateral (select b.day as e from legs b) t", "join condition"),
    ("select day from crossings where day in (select id from range(20))", "range")])
def test_governed_query_rejects(spark, sql, why):
    with pytest.raises(QueryRejected) as told:
        governed_query(spark, SCOPE, sql, 1000)
    assert why in str(told.value)
