"""A: artifact documents and tables. The documents are written from the part table, a hundred parts each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import authoring as W
from plumbline.operators import resources as N
from plumbline.plans.registry import query, table, view
from plumbline.session import scratch_path
from plumbline.sources import artifacts as A
from plumbline.sources import records as S
from plumbline.sources import tables as T

_BLOCK = "cast(floor(p_partkey / 100) as bigint)"

# One member of a document per part: a source when large, else a model; small parts carry a test.
_MEMBERS = f"""
select {_BLOCK} as block, p_partkey, p_brand, p_size,
       case when p_size >= 49 then 'sources' else 'nodes' end as collection,
       concat(case when p_size >= 49 then 'source' else 'model' end, '.shop.part_', cast(p_partkey as string)) as uid,
       to_json(named_struct(
         'resource_type', case when p_size >= 49 then 'source' else 'model' end,
         'package_name', 'shop',
         'name', concat('part_', cast(p_partkey as string)),
         'alias', case when p_size < 5 then '' else null end,
         'identifier', concat('raw_', cast(p_partkey as string)),
         'database', '"db"', 'schema', '`main`',
         'original_file_path', case when p_size < 25 then concat('models/', p_brand, '/', p_name, '.sql') end,
         'path', 'fallback.sql',
         'description', concat('  ', p_name, '   of ', p_brand, ' '),
         'tags', array(lower(p_type), 'part'),
         'group', case when p_size > 10 then p_brand end,
         'owner', case when p_size > 40 then named_struct('name', '', 'email', 'parts@shop') end,
         'meta', named_struct('tier', cast(p_size as string)),
         'config', named_struct(
            'enabled', case when p_size = 13 then false end,
            'materialized', case when p_size between 20 and 24 then 'ephemeral' else 'table' end,
            'tags', array('part', 'config'),
            'meta', named_struct('tier', 'none', 'area', p_brand)),
         'depends_on', named_struct('nodes', case when p_size between 10 and 30
            then array(concat('model.shop.part_', cast(p_partkey - 1 as string))) else array() end),
         'columns', named_struct(
            'id', named_struct('name', 'Id', 'description', 'key', 'data_type', 'integer',
                               'tags', array('pk'), 'meta', named_struct('sensitive', true)),
            'price', named_struct('description', case when p_size < 25 then ' unit  price ' else '' end))
       )) as body
from part
"""

_TEST_BODY = """
select block, 'nodes' as collection, concat('test.shop.not_null_', cast(p_partkey as string)) as uid,
       to_json(named_struct(
         'resource_type', 'test', 'name', 'not_null_generic',
         'test_metadata', case when p_size < 3 then named_struct('name', 'not_null',
             'kwargs', named_struct('column_name', 'id')) end,
         'column_name', 'price',
         'depends_on', named_struct('nodes', array(uid, concat('model.shop.gone_', cast(p_partkey as string)))))) as body
from {m} where p_size < 5
"""


def _documents(spark, sf):
    """Manifest texts; each gathers the hundred parts of its block, so its size does not grow."""
    members = view(spark, sf, _MEMBERS)
    tests = spark.sql(_TEST_BODY, m=members)
    body = lambda part: F.concat(
        F.lit("{"),
        F.array_join(
            F.collect_list(
                F.when(F.col("collection") == part, F.concat(F.lit('"'), "uid", F.lit('":'), "body"))
            ),
            ",",
        ),
        F.lit("}"),
    )
    children = (
        members.where("collection = 'nodes'")
        .groupBy("block")
        .agg(
            F.to_json(
                F.map_from_entries(
                    F.collect_list(F.struct("uid", F.array(F.concat(F.lit("exposure.shop.use_"), "p_brand"))))
                )
            ).alias("child_map")
        )
    )
    owners = F.array_distinct(F.collect_list("p_brand"))
    group_json = F.to_json(
        F.map_from_entries(
            F.transform(
                owners,
                lambda b: F.struct(
                    F.concat(F.lit("group."), b),
                    F.struct(b.alias("name"), F.struct(F.concat(F.lit("Team "), b).alias("name")).alias("owner")),
                ),
            )
        )
    )
    groups = members.groupBy("block").agg(group_json.alias("groups"))
    both = members.select("block", "collection", "uid", "body").unionByName(tests)
    made = both.groupBy("block").agg(body("nodes").alias("nodes"), body("sources").alias("sources"))
    text = F.concat(
        F.lit('{"metadata":{"dbt_schema_version":"v12","dbt_version":"1.10","block":'),
        F.col("block").cast("string"),
        F.lit('},"groups":'), "groups", F.lit(',"nodes":'), "nodes", F.lit(',"sources":'), "sources",
        F.lit(',"child_map":'), "child_map", F.lit("}"),
    )
    return made.join(groups, "block").join(children, "block").select("block", text.alias("text"))


def _manifests(spark, sf):
    """Keyed by block number instead of digest, so that the rows can be told apart in SQL."""
    parsed = A.parse_documents(_documents(spark, sf), "block")
    return A.manifests(parsed).withColumn(
        "manifest_digest", F.try_variant_get("doc", "$.metadata.block", "bigint")
    )


@query(
    "A01_read_artifacts",
    """
select doc_id, case when n_chars < 400 then 'invalid JSON' when n_chars < 800 then 'expected an object' end as problem,
       n_chars >= 800 as readable
from documents
""",
)
def a01(spark, sf):
    body = F.to_json(F.struct("lang", "source", "text"))
    texts = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") < 400, F.concat(body, F.lit("}")))
        .when(F.col("n_chars") < 800, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
        .alias("text"),
    )
    return A.parse_documents(texts, "doc_id").select(
        F.col("key").alias("doc_id"), "problem", F.col("digest").isNotNull().alias("readable")
    )


_KIND = "case when p_size >= 49 then 'source' else 'model' end"
_UID = f"concat({_KIND}, '.shop.part_', p_partkey)"
_DIGEST = f"{_BLOCK} as manifest_digest"


@query(
    "A02_resources_raw",
    f"""
select {_DIGEST}, {_UID} as unique_id, case when p_size >= 49 then 'sources' else 'nodes' end as collection from part
union all
select {_DIGEST}, concat('test.shop.not_null_', p_partkey), 'nodes' from part where p_size < 5
""",
)
def a02(spark, sf):
    return N.resources_raw(_manifests(spark, sf)).select("manifest_digest", "unique_id", "collection")


_RESOURCE_SQL = f"""
select {_DIGEST}, {_UID} as unique_id, {_KIND} as resource_type, 'shop' as package,
       concat('part_', p_partkey) as name, concat('raw_', p_partkey) as alias, 'db' as database, 'main' as schema,
       case when p_size < 25 then concat('models/', p_brand, '/', p_name, '.sql') else 'fallback.sql' end as path,
       concat(p_name, ' of ', p_brand) as description,
       list_aggregate(list_sort(['config', lower(p_type), 'part']), 'string_agg', ',') as tags,
       case when p_size > 10 then p_brand end as grp,
       case when p_size > 40 then 'parts@shop' end as owner,
       case when p_size between 20 and 24 then 'ephemeral' else 'table' end as materialized,
       cast(p_size as varchar) as tier, p_brand as area, p_size <> 13 as enabled,
       p_size <> 13 and p_size not between 20 and 24 as queryable
from part
"""


def _resources(spark, sf):
    m = _manifests(spark, sf)
    raw = N.resources_raw(m)
    return m, raw, N.normalize_resources(raw)


@query("A03_resources", _RESOURCE_SQL)
def a03(spark, sf):
    r = _resources(spark, sf)[2]
    return r.select(
        "manifest_digest", "unique_id", "resource_type", "package", "name", "alias", "database", "schema",
        "path", "description", F.array_join("tags", ",").alias("tags"), "grp", "owner", "materialized",
        F.try_variant_get(F.col("meta")["tier"], "$", "string").alias("tier"),
        F.try_variant_get(F.col("meta")["area"], "$", "string").alias("area"),
        "enabled", "queryable",
    )


@query(
    "A04_columns",
    f"""
select {_DIGEST}, {_UID} as unique_id, 'Id' as column_name, 'key' as description, 'integer' as data_type,
       'pk' as tags, true as sensitive from part
union all
select {_DIGEST}, {_UID}, 'price', case when p_size < 25 then 'unit price' else '' end, null, '', null from part
""",
)
def a04(spark, sf):
    return N.columns(_resources(spark, sf)[1]).select(
        "manifest_digest", "unique_id", "column_name", "description", "data_type",
        F.array_join("tags", ",").alias("tags"),
        F.try_variant_get(F.try_element_at("meta", F.lit("sensitive")), "$", "boolean").alias("sensitive"),
    )


@query(
    "A05_owner",
    f"""
select {_DIGEST}, {_UID} as unique_id,
       case when p_size > 40 then 'parts@shop' when p_size > 10 then concat('Team ', p_brand) end as owner
from part
""",
)
def a05(spark, sf):
    m, _, r = _resources(spark, sf)
    return N.with_owner(r, N.groups(m)).select("manifest_digest", "unique_id", "owner")


@query(
    "A06_edges",
    f"""
select {_DIGEST}, concat('model.shop.part_', p_partkey - 1) as parent_id, {_UID} as child_id, true as declared
from part where p_size between 10 and 30
union all
select {_DIGEST}, {_UID}, concat('exposure.shop.use_', p_brand), false from part where p_size < 49
union all
select {_DIGEST}, {_UID}, concat('test.shop.not_null_', p_partkey), true from part where p_size < 5
union all
select {_DIGEST}, concat('model.shop.gone_', p_partkey), concat('test.shop.not_null_', p_partkey), true from part where p_size < 5
""",
)
def a06(spark, sf):
    m, raw, _ = _resources(spark, sf)
    return N.edges(m, raw)


@query(
    "A07_tests",
    f"""
select {_DIGEST}, concat('test.shop.not_null_', p_partkey) as test_id, {_UID} as target_id,
       case when p_size < 3 then 'not_null' else 'not_null_generic' end as name,
       case when p_size < 3 then 'id' else 'price' end as column_name
from part where p_size < 5
""",
)
def a07(spark, sf):
    _, raw, r = _resources(spark, sf)
    return N.tests(raw, r).drop("arguments")


_CATALOG = f"""
select {_BLOCK} as block, concat('"', {_KIND}, '.shop.part_', cast(p_partkey as string), '":',
       to_json(named_struct('columns', named_struct(
          'ID', named_struct('name', 'ID', 'type', 'BIGINT', 'stats', named_struct('rows', p_size)),
          'color', named_struct('type', concat('VARCHAR(', cast(p_size as string), ')'))),
          'stats', named_struct('n_rows', named_struct('value', p_partkey * 10))))) as body
from part where p_size < 49 and p_size > 2
union all
select {_BLOCK}, concat('"model.shop.unknown_', cast(p_partkey as string), '":{{"columns":{{"x":{{"type":"INT"}}}}}}')
from part
"""


def _catalogs(spark, sf):
    texts = view(spark, sf, _CATALOG).groupBy("block").agg(
        F.concat(F.lit('{"nodes":{'), F.array_join(F.collect_list("body"), ","), F.lit("}}")).alias("text")
    )
    return A.parse_documents(texts, "block").select(F.col("key").alias("manifest_digest"), "doc")


def _enriched(spark, sf):
    _, raw, r = _resources(spark, sf)
    return N.enrich_catalog(N.columns(raw), N.catalog_columns(_catalogs(spark, sf)), r)


@query(
    "A08_statistics",
    f"select {_DIGEST}, {_UID} as unique_id, cast(p_partkey * 10 as bigint) as n_rows from part where p_size between 3 and 48",
)
def a08_statistics(spark, sf):
    found = N.catalog_statistics(_catalogs(spark, sf), _resources(spark, sf)[2])
    return found.select("manifest_digest", "unique_id", F.try_variant_get(F.col("statistics")["n_rows"], "$.value", "bigint").alias("n_rows"))


_ENRICHED_SQL = f"""
select {_DIGEST}, {_UID} as unique_id, 'Id' as column_name, 'integer' as data_type,
       case when p_size between 3 and 48 then 'BIGINT' end as physical_type from part
union all select {_DIGEST}, {_UID}, 'price', null, null from part
union all select {_DIGEST}, {_UID}, 'color', concat('VARCHAR(', p_size, ')'), concat('VARCHAR(', p_size, ')')
          from part where p_size between 3 and 48
"""


@query("A08_catalog", _ENRICHED_SQL)
def a08(spark, sf):
    return _enriched(spark, sf).select(
        "manifest_digest", "unique_id", "column_name", "data_type", "physical_type"
    )


@query(
    "A09_test_status",
    """
select user_id as manifest_digest, event_type as test_id, arg_max(status, event_id) as status
from (select *, case when value > 100 then 'fail' else 'pass' end as status from events) t group by 1, 2
""",
)
def a09(spark, sf):
    records = table(spark, sf, "events").select(
        F.col("user_id").alias("manifest_digest"),
        F.col("event_type").alias("test_id"),
        F.when(F.col("value") > 100, "fail").otherwise("pass").alias("status"),
        F.col("event_id").alias("pos"),
    )
    tests = records.select("manifest_digest", "test_id").distinct()
    return N.enrich_status(tests, N.latest_status(records))


@query("A10_queryable", f"select unique_id from ({_RESOURCE_SQL}) t where queryable")
def a10(spark, sf):
    return _resources(spark, sf)[2].where("queryable").select("unique_id")


@query(
    "A11_summary",
    f"""
with r as (select * from ({_RESOURCE_SQL}) t where queryable)
select manifest_digest, 'model_count' as facet, '' as value, count(*) as n_resources
from r where resource_type = 'model' group by 1
union all select manifest_digest, 'group', grp, count(*) from r where grp is not null group by 1, 3
union all select manifest_digest, 'package', package, count(*) from r group by 1, 3
union all select manifest_digest, 'path', case when path = 'fallback.sql' then '.'
                 else concat('models/', split_part(path, '/', 2)) end, count(*) from r group by 1, 3
union all select manifest_digest, 'tag', unnest(string_split(tags, ',')), count(*) from r group by 1, 3
""",
)
def a11(spark, sf):
    return N.summary(_resources(spark, sf)[2])


@query("A12_digest", "select doc_id, sha256(text) as digest from documents")
def a12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "A12_canonical_digest",
    """
select event_id, sha256(concat('{"k":', json_extract_string(props, '$.k'), ',"type":"', event_type, '"}')) as digest
from events
""",
)
def a12_canonical(spark, sf):
    loose = F.concat(
        F.lit('{ "type" : "'), "event_type", F.lit('", '), F.regexp_replace("props", r"^\{", "")
    )
    return table(spark, sf, "events").select("event_id", A.digest(F.try_parse_json(loose)).alias("digest"))


@query(
    "A13_run_records",
    """
select event_id as trace_id, concat('agent_', user_id % 20) as agent, cast(cast(ts as date) as varchar) as dt,
       value as latency_ms from events
""",
)
def a13(spark, sf):
    path = scratch_path(spark, "runs")
    runs = table(spark, sf, "events").select(
        F.col("event_id").alias("trace_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % 20).alias("agent"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("latency_ms"),
    )
    S.write_runs(runs, path)
    return S.read_runs(spark, path).select("trace_id", "agent", F.col("dt").cast("string").alias("dt"), "latency_ms")


_CASE_FIELDS = """
select l_orderkey as suite, concat('case-', cast(l_linenumber as varchar(4))) as case_name,
       case when l_quantity = 50 then '  ' else concat('How many of part ', cast(l_partkey as varchar(20)), '?') end as question,
       case when l_returnflag = 'R' and l_quantity < 5 then 'guess'
            when l_returnflag = 'A' then 'keyed' else 'unordered' end as comparison,
       case when l_tax = 0.08 then -1.0 else l_discount end as tolerance,
       case when l_linestatus = 'O' then 1 else 0 end as n_keys,
       cast(l_quantity - 3 as integer) as row_count,
       case when l_quantity > 45 then 'maybe' else 'answer' end as outcome,
       l_discount < 0.05 as has_reference, l_tax < 0.01 as has_literal,
       case when l_linenumber = 7 then 'smoke' else 'regression' end as kind,
       cast(l_quantity / 2 as integer) as trials
from lineitem
"""


@query(
    "A14_validate_cases",
    f"""
with c as (select *, count(*) over (partition by suite, case_name) as n_same from ({_CASE_FIELDS}) t)
select suite, case_name, count(*) as n,
       sum(case when trim(question) = '' then 1 else 0 end
         + case when comparison = 'guess' then 1 else 0 end
         + case when tolerance < 0 then 1 else 0 end
         + case when comparison = 'keyed' and n_keys = 0 then 1 else 0 end
         + case when row_count < 0 then 1 else 0 end
         + case when outcome = 'maybe' then 1 else 0 end
         + case when has_reference and has_literal then 1 else 0 end
         + case when kind = 'smoke' then 1 else 0 end
         + case when trials not between 1 and 20 then 1 else 0 end
         + case when n_same > 1 then 1 else 0 end)::bigint as n_errors
from c group by 1, 2
""",
)
def a14(spark, sf):
    cases = view(spark, sf, _CASE_FIELDS).select(
        F.col("suite").cast("string").alias("suite"),
        F.lit("helper").alias("agent"),
        "case_name",
        "question",
        "comparison",
        "tolerance",
        F.when(F.col("n_keys") == 1, F.array(F.lit("k"))).alias("keys"),
        "row_count",
        F.col("outcome").alias("expected_outcome"),
        "has_reference",
        F.col("has_literal").alias("has_rows"),
        F.lit(False).alias("has_value"),
        "kind",
        "trials",
    )
    checked = W.validate_cases(cases)
    return checked.groupBy(F.col("suite").cast("bigint").alias("suite"), "case_name").agg(
        F.count("*").alias("n"), F.sum(F.size("errors")).alias("n_errors")
    )


@query(
    "A14_validate_agents",
    """
select c_name as agent,
       concat_ws('; ', 'bad name', case when c_acctbal < 0 then 'empty description' end,
                 case when c_mktsegment = 'BUILDING' then 'no selector' end,
                 case when c_acctbal > 9000 then 'max_rows must be positive' end) as errors
from customer
""",
)
def a14_agents(spark, sf):
    agents = table(spark, sf, "customer").select(
        F.col("c_name").alias("agent"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise("Orders").alias("description"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.array(F.lit("group:finance"))).alias("select"),
        F.when(F.col("c_acctbal") > 9000, 0).otherwise(10).alias("max_rows"),
        F.lit(60).alias("timeout_seconds"),
    )
    return W.validate_agents(agents).select("agent", F.array_join("errors", "; ").alias("errors"))


@query("A15_source", "select o_orderkey, o_custkey, o_orderstatus from orders")
def a15(spark, sf):
    spec = T.SourceSpec("parquet", {"path": f"{sf}/orders.parquet", "schema": "main"})
    return T.source(spark, spec).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "A16_staged_orders",
    """
select cast(o_orderkey as integer) as order_id, cast(o_orderdate as date)::varchar as order_date,
       cast(o_totalprice as decimal(18,2)) as recognized_revenue, concat('C', o_custkey) as customer_id
from orders
""",
)
def a16(spark, sf):
    path = scratch_path(spark, "seed")
    orders = table(spark, sf, "orders")
    orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.format_string("%.2f", "o_totalprice").alias("recognized_revenue"),
        F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
    ).write.option("header", True).csv(path)
    staged = T.stage_orders(T.read_seed(spark, path))
    return staged.withColumn("order_date", F.col("order_date").cast("string"))
