"""B: scope, lineage and metadata quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import history as H
from plumbline.operators import scope as S
from plumbline.operators.ranking import ranked
from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, table, view

_QUERYABLE = "enabled and not (materialized is not null and materialized = 'ephemeral')"


def history(spark, sf):
    """The catalog's resources in both snapshots."""
    r = view(spark, sf, fx.RESOURCE_HISTORY)
    return r.select(
        *[c for c in r.columns if c != "tag"],
        F.array("tag").alias("tags"),
        F.expr(_QUERYABLE).alias("queryable"),
        F.expr("map('joins', parse_json(concat('\"', tag, '\"')))").alias("meta"),
        F.expr("array(parse_json('{\"type\":\"primary_key\"}'))").alias("constraints"),
        F.lit(None).cast("string").alias("owner"),
        F.lit("public").alias("access"),
    )


def resources(spark, sf):
    """The catalog's resources in the first snapshot."""
    return history(spark, sf).where("manifest_digest = 'm'")


def snapshots(spark, sf, agents):
    """Both snapshots for each agent."""
    both = F.explode(F.array(F.lit("m"), F.lit("n")))
    return agents.select("agent").distinct().select("agent", both.alias("manifest_digest"))


# One agent per nation: it selects a brand, a tag, a folder, a package, a source and a model.
_SELECTORS = """
select n_name as agent, concat('group:Brand#', cast(n_nationkey + 1 as varchar(4))) as selector, false as is_exclude from nation
union all select n_name, case when n_regionkey = 0 then 'tag:red_bolt' else 'tag:hot_gear' end, false from nation
union all select n_name, concat('path:models/Brand#', cast(n_nationkey + 2 as varchar(4)), '/promo/'), false from nation
union all select n_name, 'package:large', false from nation where n_regionkey = 1
union all select n_name, concat('model:part_', cast(n_nationkey as varchar(4))), false from nation
union all select n_name, concat('source:economy.part_', cast(n_nationkey * 7 as varchar(4))), false from nation
union all select n_name, 'package:small', true from nation where n_regionkey = 2
union all select n_name, 'tag:no_such_tag', true from nation
union all select n_name, 'color:red', false from nation where n_regionkey = 3
"""

_MATCH_SQL = f"""
select s.agent, s.is_exclude, s.selector, r.unique_id
from ({_SELECTORS}) s join (select * from ({fx.RESOURCES}) x where {_QUERYABLE}) r
  on case when r.resource_type = 'source'
          then s.selector in (concat('source:', r.unique_id), concat('source:', r.package, '.', r.name))
          else s.selector in (concat('group:', r.grp), concat('tag:', r.tag), concat('package:', r.package),
                              concat('model:', r.name), concat('model:', r.unique_id),
                              concat('model:', r.package, '.', r.name), concat('path:', r.path))
               or (s.selector like 'path:%' and starts_with(r.path, concat(rtrim(substr(s.selector, 6), '/'), '/')))
     end
"""
_SCOPE_SQL = f"""
select distinct agent, unique_id from ({_MATCH_SQL}) m where not is_exclude
except select agent, unique_id from ({_MATCH_SQL}) m where is_exclude
"""


def _selectors(spark, sf):
    return view(spark, sf, _SELECTORS)


def _agents(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("agent"),
        F.lit(False).alias("include_parents"),
        F.lit(False).alias("include_children"),
    )


def _scopes(spark, sf):
    return S.resolve_scope(_agents(spark, sf), _selectors(spark, sf), resources(spark, sf))


@query("B01_match_selectors", f"select distinct agent, selector, unique_id from ({_MATCH_SQL}) m")
def b01(spark, sf):
    return S.match_selectors(resources(spark, sf), _selectors(spark, sf)).select("agent", "selector", "unique_id")


@query("B02_scope", _SCOPE_SQL)
def b02(spark, sf):
    return _scopes(spark, sf).select("agent", "unique_id")


def graph(spark, sf):
    r = view(spark, sf, fx.GRAPH_RESOURCES).select(
        F.lit("m").alias("manifest_digest"),
        "unique_id",
        "resource_type",
        F.expr(_QUERYABLE).alias("queryable"),
    )
    e = view(spark, sf, fx.EDGES).select(
        F.lit("m").alias("manifest_digest"), "parent_id", "child_id", F.lit(True).alias("declared")
    )
    return r, e


_WALK = """
with recursive e as ({edges}),
     walk(start, unique_id) as (
       select distinct {src}, {dst} from e
       union all select w.start, e.{dst} from walk w join e on e.{src} = w.unique_id)
select start, unique_id from walk
"""
_OPEN = f"select unique_id from ({fx.GRAPH_RESOURCES}) g where {_QUERYABLE} and resource_type <> 'source'"


def _closure(spark, sf, direction):
    r, e = graph(spark, sf)
    starts = r.select("manifest_digest", "unique_id", F.col("unique_id").alias("start"))
    reached = S.closure(e, starts, direction, r)
    return S._askable(reached, r).select("start", "unique_id")


@query(
    "B03_upstream",
    f"select * from ({_WALK.format(edges=fx.EDGES, src='child_id', dst='parent_id')}) w where unique_id in ({_OPEN})",
)
def b03(spark, sf):
    return _closure(spark, sf, "up")


@query(
    "B04_downstream",
    f"select * from ({_WALK.format(edges=fx.EDGES, src='parent_id', dst='child_id')}) w where unique_id in ({_OPEN})",
)
def b04(spark, sf):
    return _closure(spark, sf, "down")


@query(
    "B05_both_ways",
    f"""
with up as (select * from ({_WALK.format(edges=fx.EDGES, src='child_id', dst='parent_id')}) w
            where unique_id in ({_OPEN})),
     down as (select * from ({_WALK.format(edges=fx.EDGES, src='parent_id', dst='child_id')}) w
              where unique_id in ({_OPEN})),
     chosen as (select n_name as agent, concat('customer.', c_custkey) as unique_id
                from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' and c_acctbal > 9000),
     wide as (select * from chosen union select agent, up.unique_id from chosen join up on up.start = chosen.unique_id)
select agent, unique_id from wide union select agent, down.unique_id from wide join down on down.start = wide.unique_id
""",
)
def b05(spark, sf):
    r, e = graph(spark, sf)
    nation = table(spark, sf, "nation")
    chosen = (
        table(spark, sf, "customer")
        .where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("agent"),
            F.lit("m").alias("manifest_digest"),
            F.concat(F.lit("customer."), "c_custkey").alias("unique_id"),
        )
    )
    agents = nation.select(
        F.col("n_name").alias("agent"),
        F.lit(True).alias("include_parents"),
        F.lit(True).alias("include_children"),
    )
    return S.expand_scope(chosen, agents, r, e).select("agent", "unique_id")


def everyone(resources):
    """A single scope holding every queryable resource."""
    return resources.where("queryable").select(F.lit("all").alias("agent"), "manifest_digest", "unique_id")


KEYS_SQL = f"""
select manifest_digest, relation, count(*) as n_matches, min(unique_id) as unique_id
from (select distinct manifest_digest, unique_id, relation from (
        select manifest_digest, unique_id, unnest([lower(name), lower(alias), replace(lower(relation_name), '"', ''),
                                  concat(schema, '.', lower(alias)), concat(database, '.', schema, '.', lower(alias))]) as relation
        from ({fx.RESOURCE_HISTORY}) r where {_QUERYABLE}) x) y
group by manifest_digest, relation
"""
RESOLVED_SQL = f"""
select q.query_id, q.ord, d.manifest_digest, case when k.n_matches is null then 'out_of_scope'
                               when k.n_matches > 1 then 'ambiguous' else 'resolved' end as status,
       case when k.n_matches = 1 then k.unique_id end as unique_id
from ({fx.RELATIONS}) q join ({fx.QUERY_DIGESTS}) d using (query_id)
left join ({KEYS_SQL}) k on k.manifest_digest = d.manifest_digest and k.relation = lower(replace(q.ref, '"', ''))
"""


def _of(log, only):
    return log if only is None else log.join(only, "query_id", "left_semi")


def relations(spark, sf, only=None):
    """References of the query log, numbered within their query; ``only(query_id)`` names the queries asked for, else all are."""
    rows = ranked(_of(view(spark, sf, fx.RELATION_ROWS), only), ["query_id"], fx.RELATION_POSITION, "ord")
    return rows.withColumn("ord", F.col("ord") + 1)


def queries(spark, sf, only=None):
    """The query log with the snapshot that was in force for each query."""
    log = H.in_force(_of(view(spark, sf, fx.QUERY_LOG), only), view(spark, sf, fx.SNAPSHOTS))
    return log.select("query_id", "agent", "manifest_digest")


def resolved(spark, sf):
    refs = relations(spark, sf).select("query_id", "ord", "ref").join(queries(spark, sf), "query_id")
    r = history(spark, sf)
    return S.resolve_relations(refs, S.relation_keys(everyone(r), r))


@query("B06_relations", RESOLVED_SQL)
def b06(spark, sf):
    return resolved(spark, sf).select("query_id", "ord", "manifest_digest", "status", "unique_id")


@query("B06_in_force", f"select query_id, agent, manifest_digest from ({fx.QUERY_DIGESTS}) d")
def b06_in_force(spark, sf):
    return queries(spark, sf)


@query(
    "B07_duplicate_aliases",
    f"""
with r as (select lower(alias) as alias, unique_id from ({fx.RESOURCES}) x where {_QUERYABLE})
select alias, unique_id from r where alias in (select alias from r group by alias having count(*) > 1)
""",
)
def b07(spark, sf):
    r = resources(spark, sf)
    return S.duplicate_aliases(everyone(r), r).select("alias", "unique_id")


# Columns on the lineage graph: regions and nations document theirs, customers only some, orders none.
_GRAPH_COLUMNS = """
select concat('region.', cast(r_regionkey as varchar(20))) as unique_id, 'key' as column_name, 'region key' as description from region
union all select concat('nation.', cast(n_nationkey as varchar(20))), 'key',
                 case when n_regionkey < 2 then 'nation key' else 'region key' end from nation
union all select concat('nation.', cast(n_nationkey as varchar(20))), 'name', 'name of nation' from nation
union all select concat('customer.', cast(c_custkey as varchar(20))), 'key', '' from customer
union all select concat('customer.', cast(c_custkey as varchar(20))), 'segment',
                 case when c_acctbal > 5000 then c_mktsegment else '' end from customer
union all select concat('order.', cast(o_orderkey as varchar(20))), 'key', '' from orders
union all select concat('order.', cast(o_orderkey as varchar(20))), 'segment', '' from orders
"""
_INHERITED_SQL = f"""
with up as ({_WALK.format(edges=fx.EDGES, src='child_id', dst='parent_id')}),
     c as ({_GRAPH_COLUMNS})
select c.unique_id, c.column_name, min(p.description) as description
from c join up on up.start = c.unique_id
       join c p on p.unique_id = up.unique_id and p.column_name = c.column_name and trim(p.description) <> ''
where c.description = '' group by 1, 2 having count(distinct p.description) = 1
"""


# In the second snapshot the regions no longer describe their key.
_GRAPH_COLUMNS_LATER = f"select unique_id, column_name, case when unique_id like 'region.%' then '' else description end as description from ({_GRAPH_COLUMNS}) g"


def _graph_columns(spark, sf):
    return view(spark, sf, _GRAPH_COLUMNS).withColumn("manifest_digest", F.lit("m"))


def _graph_history(spark, sf):
    """Resources, edges and columns of the lineage graph in both snapshots."""
    r, e = graph(spark, sf)
    later = view(spark, sf, _GRAPH_COLUMNS_LATER).withColumn("manifest_digest", F.lit("n"))
    both = [t.unionByName(t.withColumn("manifest_digest", F.lit("n"))) for t in (r, e)]
    return *both, _graph_columns(spark, sf).unionByName(later)


def _inherited(spark, sf):
    r, e = graph(spark, sf)
    columns = _graph_columns(spark, sf)
    return S.inherit_descriptions(columns, S.ancestors(S.undocumented(columns), e, r))


@query("B08_inherited_descriptions", _INHERITED_SQL)
def b08(spark, sf):
    return _inherited(spark, sf).select("unique_id", "column_name", "description")


def _missing_sql(digest, columns):
    return f"""
select '{digest}' as manifest_digest, unique_id, column_name from ({columns}) c where description = ''
  and not exists (select 1 from ({_INHERITED_SQL.replace(_GRAPH_COLUMNS, columns)}) i where i.unique_id = c.unique_id and i.column_name = c.column_name)
union all select '{digest}', unique_id, null from ({fx.GRAPH_RESOURCES}) g where resource_type = 'source'
"""


@query("B09_missing_descriptions", f"{_missing_sql('m', _GRAPH_COLUMNS)} union all {_missing_sql('n', _GRAPH_COLUMNS_LATER)}")
def b09(spark, sf):
    r, e, columns = _graph_history(spark, sf)
    inherited = S.inherit_descriptions(columns, S.ancestors(S.undocumented(columns), e, r))
    r = r.withColumn("description", F.when(F.col("resource_type") == "source", "").otherwise("x"))
    scopes = r.select(F.lit("all").alias("agent"), "manifest_digest", "unique_id")
    return S.missing_descriptions(scopes, r, columns, inherited).select("manifest_digest", "unique_id", "column_name")


@query(
    "B10_facets",
    f"""
with r as (select * from ({fx.RESOURCE_HISTORY}) x where {_QUERYABLE}), m as (select * from r where resource_type = 'model')
select manifest_digest, 'group' as kind, grp as value, 'dbt group' as label, count(*) as n_resources from m group by manifest_digest, grp
union all select manifest_digest, 'tag', tag, 'dbt tag', count(*) from m group by manifest_digest, tag
union all select manifest_digest, 'package', package, 'dbt package', count(*) from m group by manifest_digest, package
union all select manifest_digest, 'path', concat('models/', grp, '/', package), 'dbt model path', count(*) from m group by manifest_digest, grp, package
union all select manifest_digest, 'model', concat(package, '.', name), case when description = '' then relation_name else description end, 1
          from m where name not like 'new_%'
union all select manifest_digest, 'source', regexp_extract(unique_id, '([^.]*[.][^.]*)$', 1), case when description = '' then alias else description end, 1
          from r where resource_type = 'source'
union all select manifest_digest, 'model', concat(package, '.', name), case when description = '' then relation_name else description end, 1
          from m where name like 'new_%'
""",
)
def b10(spark, sf):
    r = history(spark, sf)
    out = None
    for kind in ("group", "tag", "package", "path", "model", "source"):
        part = S.selector_facets(r, kind).select("manifest_digest", F.lit(kind).alias("kind"), "value", "label", "n_resources")
        out = part if out is None else out.unionByName(part)
    return out


_MATCH_HISTORY_SQL = _MATCH_SQL.replace(fx.RESOURCES, fx.RESOURCE_HISTORY).replace("r.unique_id\nfrom", "r.unique_id, r.manifest_digest\nfrom")


@query(
    "B11_unmatched_selectors",
    f"""
with m as ({_MATCH_HISTORY_SQL})
select agent, d as manifest_digest, selector, 'matched no queryable resources' as problem
from ({_SELECTORS}) s, (values ('m'), ('n')) v(d)
where not is_exclude and selector not like 'color:%'
  and not exists (select 1 from m where m.agent = s.agent and m.selector = s.selector and m.manifest_digest = d)
union all select agent, null, selector, 'unsupported selector' from ({_SELECTORS}) s where selector like 'color:%'
""",
)
def b11(spark, sf):
    selectors = _selectors(spark, sf)
    return S.unmatched_selectors(history(spark, sf), selectors, snapshots(spark, sf, selectors))


def _part_columns(spark, sf):
    return table(spark, sf, "part").select(
        F.lit("m").alias("manifest_digest"),
        F.concat(F.lit("model."), F.lower("p_type"), F.lit(".part_"), "p_partkey").alias("unique_id"),
        F.lit(0).alias("ordinal"),
        F.lit("price").alias("column_name"),
        F.lit("double").alias("data_type"),
        F.when(F.col("p_size") > 25, "DOUBLE").alias("physical_type"),
        F.when(F.col("p_size") > 45, "unit price").otherwise("").alias("description"),
    )


@query(
    "B12_scope_report",
    f"""
with r as (select * from ({fx.RESOURCES}) x), s as ({_SCOPE_SQL}),
     p as (select *, concat('model.', lower(p_type), '.part_', p_partkey) as uid from part),
     lines as (
select unique_id, '0 resource' as section, relation_name as line from r
union all select unique_id, '1 metadata', concat_ws(', ', case when materialized is not null then concat('materialized=', materialized) end,
                 'access=public', concat('group=', grp), concat('package=', package)) from r
union all select unique_id, '2 description', description from r where description <> ''
union all select uid, '5 column', concat('price [', case when p_size > 25 then 'DOUBLE' else 'double' end, ']',
                 case when p_size > 45 then ' — unit price' else '' end) from p
union all select uid, '6 test', 'not_null' from p where p_size < 5
union all select unique_id, '7 constraint', '{{"type":"primary_key"}}' from r
union all select unique_id, '8 joins', concat('"', tag, '"') from r
union all select concat('model.', lower(p_type), '.part_', p_partkey), '3 upstream', concat('base_', p_brand) from part)
select s.agent, s.unique_id, section, line from s join lines l on l.unique_id = s.unique_id
""",
)
def b12(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "uid", F.concat(F.lit("model."), F.lower("p_type"), F.lit(".part_"), "p_partkey")
    )
    tests = part.where("p_size < 5").select(
        F.lit("m").alias("manifest_digest"),
        F.concat(F.lit("test."), "p_partkey").alias("test_id"),
        F.col("uid").alias("target_id"),
        F.lit("not_null").alias("name"),
        F.expr("parse_json('{}')").alias("arguments"),
    )
    edges = part.select(
        F.lit("m").alias("manifest_digest"),
        F.concat(F.lit("base_"), "p_brand").alias("parent_id"),
        F.col("uid").alias("child_id"),
        F.lit(True).alias("declared"),
    )
    columns = _part_columns(spark, sf)
    none = columns.where("false").select("manifest_digest", "unique_id", "column_name", "description")
    return S.scope_report(_scopes(spark, sf), resources(spark, sf), columns, tests, edges, none).drop("item")


@query(
    "B12_resource_details",
    f"""
with s as ({_SCOPE_SQL}), p as (select *, concat('model.', lower(p_type), '.part_', p_partkey) as uid from part)
select agent, unique_id, 1 as n_columns, 'price' as column_names, case when p_size < 5 then 1 else 0 end as n_tests
from s join p on uid = unique_id
""",
)
def b12_details(spark, sf):
    tests = table(spark, sf, "part").where("p_size < 5").select(
        F.lit("m").alias("manifest_digest"),
        F.concat(F.lit("test."), "p_partkey").alias("test_id"),
        F.concat(F.lit("model."), F.lower("p_type"), F.lit(".part_"), "p_partkey").alias("target_id"),
        F.lit("not_null").alias("name"),
        F.lit("price").alias("column_name"),
        F.lit("pass").alias("status"),
    )
    found = S.resource_details(_scopes(spark, sf), resources(spark, sf), _part_columns(spark, sf), tests)
    names = F.array_join(F.transform("columns", lambda c: c["column_name"]), ",")
    return found.select(
        "agent",
        "unique_id",
        F.size("columns").alias("n_columns"),
        names.alias("column_names"),
        F.coalesce(F.nullif(F.size("tests"), F.lit(-1)), F.lit(0)).alias("n_tests"),
    )


@query(
    "B13_catalog_coverage",
    f"""
select 'm' as manifest_digest, count(*) as n_columns, count(*) filter (where p_size > 25) as n_physical
from part join ({fx.RESOURCES}) r on r.unique_id = concat('model.', lower(p_type), '.part_', p_partkey)
where {_QUERYABLE}
""",
)
def b13(spark, sf):
    return S.catalog_coverage(_part_columns(spark, sf), resources(spark, sf))


@query(
    "B14_agent_sizes",
    """
select n_name as agent, d as manifest_digest, count(c_custkey) as n_resources,
       case when n_regionkey = 4 then 'duplicated' when count(c_custkey) = 0 then 'empty scope' end as problem
from nation, (values ('m', 9900), ('n', 9950)) v(d, least) left join customer on c_nationkey = n_nationkey and c_acctbal > least
group by n_name, n_regionkey, d
""",
)
def b14(spark, sf):
    nation = table(spark, sf, "nation")
    agents = nation.select(F.col("n_name").alias("agent")).union(
        nation.where("n_regionkey = 4").select("n_name")
    )
    owned = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("agent"), F.col("c_name").alias("unique_id"), "c_acctbal")
    first = owned.where("c_acctbal > 9900").withColumn("manifest_digest", F.lit("m"))
    later = owned.where("c_acctbal > 9950").withColumn("manifest_digest", F.lit("n"))
    return S.agent_sizes(agents, first.unionByName(later), snapshots(spark, sf, agents))
