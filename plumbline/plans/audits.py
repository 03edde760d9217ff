"""C: access audit of a query log made from line items: one query per order, one reference per line."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import scope as S
from plumbline.plans import fixtures as fx
from plumbline.plans import scopes as B
from plumbline.plans.registry import query, table, view
from plumbline.session import stored

_STATEMENTS = """
select user_id as query_id, event_id as ord, case when value > 200 then 1 else 0 end as depth,
       case event_type when 'error' then 'DELETE' when 'signup' then 'union' else 'select' end as kind
from events
union all
select 1000000 + event_id, 0, 0, case event_type when 'error' then 'drop' when 'signup' then 'union' else 'select' end from events
union all
select 1000000 + event_id, 1, 1, case when value > 100 then 'insert' else 'select' end from events
"""


@query(
    "C02_read_only",
    f"""
with q as (select query_id, count(*) filter (where depth = 0) as n,
                  bool_and(lower(kind) in ('select', 'union')) filter (where depth = 0) as is_query,
                  bool_or(lower(kind) in ('delete', 'drop', 'insert')) as writes
           from ({_STATEMENTS}) s group by 1)
select query_id, case when n <> 1 then 'Exactly one SQL query statement is required'
                      when not is_query then 'Only a read-only query statement is allowed'
                      else 'SQL contains a forbidden write or command operation' end as message
from q where n <> 1 or not is_query or writes
""",
)
def c02(spark, sf):
    return A.audit_read_only(view(spark, sf, _STATEMENTS)).select("query_id", "message")


@query(
    "C03_functions",
    """
select distinct event_id as query_id,
       concat('Function ''', case event_type when 'error' then 'READ_CSV' else 'nextval' end, ''' is forbidden') as message
from events where event_type in ('error', 'signup')
""",
)
def c03(spark, sf):
    functions = table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        F.lit(0).alias("ord"),
        F.when(F.col("event_type") == "error", "READ_CSV")
        .when(F.col("event_type") == "signup", "nextval")
        .otherwise("sum")
        .alias("name"),
    )
    return A.audit_functions(functions).select("query_id", "message")


def _log(spark, sf, only=None):
    """Facts of the query log, or of the queries ``only(query_id)``. Line 1 references are CTE names; the rest are relations.

    Queries with their snapshots, numbered references with those of their query, and the resolved relations are read by every check: each is
    written once, as columns, and the shuffles that made it are gone before the next one.
    """
    queries = stored(B.queries(spark, sf, only), "queries")
    numbered = B.relations(spark, sf, only).join(queries.withColumn("is_logged", F.lit(True)), "query_id", "left")
    refs = stored(numbered.select("query_id", "ord", "l_partkey", "ref", "agent", "manifest_digest", "is_logged"), "references")
    relations = refs.where("is_logged").select(
        "query_id",
        "ord",
        "agent",
        "manifest_digest",
        "ref",
        ((F.col("ord") == 1) & ~F.contains("ref", F.lit("."))).alias("is_cte"),
    )
    catalog = B.history(spark, sf)
    keys = stored(S.relation_keys(B.everyone(catalog), catalog), "relation-keys")
    resolved = S.resolve_relations(A.base_relations(relations).drop("is_cte"), keys)
    resolved = stored(resolved, "resolved-relations").withColumn("alias", F.concat(F.lit("T"), "ord"))
    return queries, refs, resolved


_BASE = f"""
select r.query_id, r.ord, f.ref, r.manifest_digest, r.status, r.unique_id
from ({B.RESOLVED_SQL}) r join ({fx.RELATIONS}) f on f.query_id = r.query_id and f.ord = r.ord
where r.ord <> 1 or contains(f.ref, '.')
"""


@query(
    "C04_scope",
    f"""
select distinct query_id, concat('Relation ''', ref, ''' is ', case when status = 'ambiguous' then 'ambiguous'
       else 'not a manifest-backed resource in agent scope' end) as message
from ({_BASE}) b where status <> 'resolved'
union all
select query_id, 'SQL must query at least one manifest-backed relation'
from (select distinct query_id from ({fx.RELATIONS}) f) q where query_id not in (select query_id from ({_BASE}) b)
""",
)
def c04(spark, sf):
    queries, _, resolved = _log(spark, sf)
    return A.audit_scope(queries, resolved).select("query_id", "message")


_JOINS = """
select l_orderkey as query_id, l_linenumber as ord, l_discount > 0.01 or l_quantity <= 10 as has_on, l_tax > 0.07 as has_using
from lineitem
"""


@query(
    "C05_joins",
    f"""
select u.query_id, 'Every multi-relation query requires explicit join conditions' as message
from (select query_id from ({_BASE}) b where status = 'resolved' group by 1 having count(distinct unique_id) > 1) u
left join (select query_id, bool_and(has_on or has_using) as ok from ({_JOINS}) j group by 1) j on j.query_id = u.query_id
where not coalesce(ok, false)
""",
)
def c05(spark, sf):
    _, _, resolved = _log(spark, sf)
    return A.audit_joins(A.used_resources(resolved), view(spark, sf, _JOINS)).select("query_id", "message")


# Every resource has an 'id'; small parts also 'size', others 'price', which the second snapshot calls 'cost' for large ones.
_RESOURCE_COLUMNS = """
select manifest_digest, concat('model.', lower(p_type), '.part_', cast(p_partkey as varchar(20))) as unique_id, 'Id' as column_name
from part cross join (values ('m'), ('n')) as d(manifest_digest)
union all select manifest_digest, concat('model.', lower(p_type), '.part_', cast(p_partkey as varchar(20))),
                 case when p_size < 25 then 'size' when p_size > 45 and manifest_digest = 'n' then 'cost' else 'price' end
from part cross join (values ('m'), ('n')) as d(manifest_digest)
"""

_COLUMN_REFS = """
select query_id, ord,
       case when l_partkey < 500 then '' when l_partkey < 1000 then concat('t', cast(ord as varchar(4)))
            when l_partkey < 1500 then 'cte' else 'nowhere' end as qualifier,
       case when ref like 'part%' then 'SIZE' when ref like '"%' then 'price' when ref = 'missing_table' then 'total' else 'id' end as name
from {refs} r
"""

RESOLVED_COLUMNS_SQL = f"""
with used as (select distinct query_id, manifest_digest, unique_id from ({_BASE}) b where status = 'resolved'),
     aliased as (select query_id, concat('t', ord) as alias, manifest_digest, unique_id from ({_BASE}) b where status = 'resolved'),
     cols as (select manifest_digest, unique_id, lower(column_name) as folded from ({_RESOURCE_COLUMNS}) c),
     anywhere as (select query_id, folded, count(*) as n from used join cols using (manifest_digest, unique_id) group by 1, 2)
select r.query_id, r.ord, r.qualifier, r.name,
       case when r.qualifier = 'cte' then case when lower(r.name) in ('id', 'total') then 'derived' else 'derived_missing' end
            when r.qualifier <> '' and a.unique_id is not null
              then case when exists (select 1 from cols c where c.manifest_digest = a.manifest_digest and c.unique_id = a.unique_id and c.folded = lower(r.name))
                        then 'found' else 'missing' end
            when coalesce(w.n, 0) = 0 then case when r.qualifier = '' and r.name = 'total' then 'alias' else 'missing' end
            when r.qualifier = '' and w.n > 1 then 'ambiguous' else 'found' end as status
from ({_COLUMN_REFS.format(refs=f"({fx.RELATIONS})")}) r
left join aliased a on a.query_id = r.query_id and a.alias = r.qualifier
left join anywhere w on w.query_id = r.query_id and w.folded = lower(r.name)
"""


def _resolved_columns(spark, sf, queries, refs, resolved):
    ids = queries.select("query_id")
    derived = ids.select(
        "query_id", F.lit("CTE").alias("alias"), F.explode(F.array(F.lit("Id"), F.lit("total"))).alias("column_name")
    )
    return A.resolve_columns(
        spark.sql(_COLUMN_REFS, refs=refs),
        A.query_usage(resolved),
        A.used_resources(resolved),
        derived,
        ids.withColumn("name", F.lit("total")),
        view(spark, sf, _RESOURCE_COLUMNS),
    )


def resolved_log(spark, sf, only=None):
    queries, refs, resolved = _log(spark, sf, only)
    return queries, resolved, _resolved_columns(spark, sf, queries, refs, resolved)


@query("C06_columns", RESOLVED_COLUMNS_SQL)
def c06(spark, sf):
    return resolved_log(spark, sf)[2]


def _column_messages(status, text):
    return f"select distinct query_id, {text} as message from ({RESOLVED_COLUMNS_SQL}) c where status = '{status}'"


@query(
    "C07_ambiguous",
    _column_messages(
        "ambiguous", "concat('Unqualified column ''', name, ''' is ambiguous across selected dbt resources')"
    ),
)
def c07(spark, sf):
    found = A.audit_columns(resolved_log(spark, sf)[2])
    return found.where(F.contains("message", F.lit("ambiguous"))).select("query_id", "message")


@query(
    "C08_derived",
    _column_messages(
        "derived_missing",
        "concat('Column ''', qualifier, '.', name, ''' does not exist in derived relation ''', qualifier, '''')",
    ),
)
def c08(spark, sf):
    found = A.audit_columns(resolved_log(spark, sf)[2])
    return found.where(F.contains("message", F.lit("derived"))).select("query_id", "message")


# Small parts are sensitive, in the second snapshot also those of size 10; agents may see the smallest.
_SENSITIVE_META = """
select manifest_digest, concat('model.', lower(p_type), '.part_', cast(p_partkey as varchar(20))) as unique_id, p_size,
       p_size < 5 or (p_size = 10 and manifest_digest = 'n') as is_model, p_size > 30 as lists_price, p_size < 10 as flags_size
from part cross join (values ('m'), ('n')) as d(manifest_digest)
"""


def _sensitive(spark, sf):
    part = view(spark, sf, _SENSITIVE_META)
    meta = F.when(F.col("is_model"), F.expr("map('sensitive', parse_json('true'))")).when(
        F.col("lists_price"), F.expr("map('sensitive_columns', parse_json('[\"Price\"]'))")
    )
    resources = part.select("manifest_digest", "unique_id", meta.alias("meta"))
    columns = part.select(
        "manifest_digest",
        "unique_id",
        F.when(F.col("p_size") < 25, "size").otherwise("price").alias("column_name"),
        F.when(F.col("flags_size"), F.expr("map('sensitive', parse_json('true'))")).alias("meta"),
    )
    allow = part.select(F.lit("all").alias("agent"), F.when(F.col("p_size") < 3, F.col("unique_id")).otherwise("public").alias("item")).distinct()
    return resources, columns, allow


USED_SQL = f"select query_id, manifest_digest, unique_id, min(ord) as ord from ({_BASE}) b where status = 'resolved' group by 1, 2, 3"

_SENSITIVE_MODELS_SQL = f"""
select query_id, 2 * ord as pos, concat('Sensitive model ''', unique_id, ''' requires explicit permission') as message
from ({USED_SQL}) u join ({_SENSITIVE_META}) s using (manifest_digest, unique_id) where is_model and p_size >= 3
"""


@query("C09_sensitive_models", f"select query_id, message from ({_SENSITIVE_MODELS_SQL}) s")
def c09(spark, sf):
    queries, _, resolved = _log(spark, sf)
    resources, _, allow = _sensitive(spark, sf)
    return A.audit_sensitive_models(A.used_resources(resolved), queries, resources, allow).select(
        "query_id", "message"
    )


_SENSITIVE_COLUMNS_SQL = f"""
select query_id, 2 * ord + 1 as pos, concat('Sensitive columns require explicit permission: ', string_agg(name, ', ' order by name)) as message
from (select distinct n.query_id, u.unique_id, u.ord, n.name
      from (select distinct query_id, name from ({RESOLVED_COLUMNS_SQL}) c where status in ('found', 'ambiguous')) n
      join ({USED_SQL}) u on u.query_id = n.query_id
      join ({_SENSITIVE_META}) s on s.manifest_digest = u.manifest_digest and s.unique_id = u.unique_id
        and ((flags_size and lower(n.name) = 'size') or (lists_price and not is_model and lower(n.name) = 'price'))) x
group by query_id, unique_id, ord
"""


@query("C10_sensitive_columns", f"select query_id, message from ({_SENSITIVE_COLUMNS_SQL}) s")
def c10(spark, sf):
    queries, resolved, columns = resolved_log(spark, sf)
    resources, declared, allow = _sensitive(spark, sf)
    return A.audit_sensitive_columns(
        stored(A.used_resources(resolved), "used-resources"),
        stored(A.used_columns(columns), "used-columns"),
        queries,
        A.sensitive_columns(resources, declared),
        allow,
    ).select("query_id", "message")


@query(
    "C12_usage",
    f"""
select query_id, 'model' as kind, unique_id as item from ({USED_SQL}) u
union all
select distinct query_id, 'column', name from ({RESOLVED_COLUMNS_SQL}) c where status in ('found', 'ambiguous')
""",
)
def c12(spark, sf):
    _, resolved, columns = resolved_log(spark, sf)
    models = A.used_resources(resolved).select("query_id", F.lit("model").alias("kind"), F.col("unique_id").alias("item"))
    return models.unionByName(
        stored(A.used_columns(columns), "used-columns").select("query_id", F.lit("column").alias("kind"), F.col("name").alias("item"))
    )


# What the statements of the log are, and which functions they call, line by line.
_LOG_STATEMENTS = """
select l_orderkey as query_id, 0 as ord, 0 as depth, case when sum(l_quantity) > 260 then 'update' else 'select' end as kind
from lineitem group by l_orderkey
"""
_LOG_FUNCTIONS = """
select l_orderkey as query_id, l_linenumber as ord,
       case when l_extendedprice > 100000 then 'read_csv' when l_extendedprice < 1000 then 'nextval' else 'sum' end as name
from lineitem
"""


@query(
    "C13_verdict",
    f"""
with f as (
  select query_id, 0 as step, 0 as pos, 'read_only' as chk, 'Only a read-only query statement is allowed' as message
  from ({_LOG_STATEMENTS}) s where kind = 'update'
  union all
  select query_id, 1, ord, 'forbidden_functions', concat('Function ''', name, ''' is forbidden') from ({_LOG_FUNCTIONS}) g where name <> 'sum'
  union all
  select query_id, 2, ord, case when status = 'ambiguous' then 'relations_unambiguous' else 'resources_in_scope' end,
         concat('Relation ''', ref, ''' is ', case when status = 'ambiguous' then 'ambiguous'
                else 'not a manifest-backed resource in agent scope' end)
  from ({_BASE}) b where status <> 'resolved'
  union all
  select query_id, 2, 0, 'resources_in_scope', 'SQL must query at least one manifest-backed relation'
  from (select distinct query_id from ({fx.RELATIONS}) f) q where query_id not in (select query_id from ({_BASE}) b)
  union all
  select u.query_id, 4, 0, 'join_conditions', 'Every multi-relation query requires explicit join conditions'
  from (select query_id from ({USED_SQL}) b group by 1 having count(*) > 1) u
  left join (select query_id, bool_and(has_on or has_using) as ok from ({_JOINS}) j group by 1) j on j.query_id = u.query_id
  where not coalesce(ok, false)
  union all
  select query_id, 5, ord, 'columns_exist',
         case status when 'derived_missing' then concat('Column ''', qualifier, '.', name, ''' does not exist in derived relation ''', qualifier, '''')
                     when 'missing' then concat('Column ''', case when qualifier <> '' then concat(qualifier, '.') else '' end, name,
                                                ''' does not exist on a selected dbt resource')
                     else concat('Unqualified column ''', name, ''' is ambiguous across selected dbt resources') end
  from ({RESOLVED_COLUMNS_SQL}) c where status in ('derived_missing', 'missing', 'ambiguous')
  union all select query_id, 6, pos, 'sensitive_access', message from ({_SENSITIVE_MODELS_SQL}) s
  union all select query_id, 6, pos, 'sensitive_access', message from ({_SENSITIVE_COLUMNS_SQL}) s),
 first as (select query_id, arg_min(chk, {{'s': step, 'p': pos, 'm': message}}) as chk, arg_min(message, {{'s': step, 'p': pos, 'm': message}}) as message
           from f group by 1)
select q.query_id, first.query_id is null as passed, first.chk as failed_check, first.message
from (select distinct query_id from ({fx.RELATIONS}) f) q left join first on first.query_id = q.query_id
""",
)
def c13(spark, sf):
    """All seven checks over one resolved log; the first failure by check and place decides."""
    queries, refs, resolved = _log(spark, sf)
    columns = stored(_resolved_columns(spark, sf, queries, refs, resolved), "resolved-columns")
    used = stored(A.used_resources(resolved), "used-resources")
    resources, declared, allow = _sensitive(spark, sf)
    return A.audit(
        queries,
        A.audit_read_only(view(spark, sf, _LOG_STATEMENTS)),
        A.audit_functions(view(spark, sf, _LOG_FUNCTIONS)),
        A.audit_scope(queries, resolved),
        A.audit_joins(used, view(spark, sf, _JOINS)),
        A.audit_columns(columns),
        A.audit_sensitive_models(used, queries, resources, allow),
        A.audit_sensitive_columns(used, A.used_columns(columns), queries, A.sensitive_columns(resources, declared), allow),
    )


# Terms an agent must not be asked about: part names in the order of their keys, and some short ones after them.
_GUARD_TERMS = """
select 'helper' as agent, cast(1000000 + p_partkey as bigint) as ord, p_name as term from part
union all select 'helper', 1, 'UNGEN' union all select 'helper', 3, 'eau' union all select 'helper', 2, 'TION'
union all select 'helper', 9, 'zq' union all select 'helper', 4, 'straßenlaterne'
"""


@query(
    "C14_guard",
    f"""
with t as (select ord, term, replace(lower(term), 'ß', 'ss') as f from ({_GUARD_TERMS}) x),
     q as (select conv_id, turn, replace(lower(text), 'ß', 'ss') as q from conversations where role = 'user')
select conv_id, turn, (select arg_min(term, ord) from t where contains(q.q, t.f)) as blocked_term from q
""",
)
def c14(spark, sf):
    questions = view(spark, sf, fx.QUESTIONS).withColumn("agent", F.lit("helper"))
    return A.guard_questions(questions, view(spark, sf, _GUARD_TERMS)).select("conv_id", "turn", "blocked_term")


@query(
    "C15_render_refs",
    f"""
with r as (select * from ({fx.RESOURCE_HISTORY}) x where enabled and not (materialized is not null and materialized = 'ephemeral'))
select p_partkey as template_id, d as manifest_digest,
       case when p_size = 7 then null when r.unique_id is null then null
            else concat('select * from ', r.relation_name, ' where x = ''', p_name, ''' and y in (select y from ', r.relation_name, ')') end as rendered,
       case when p_size = 7 then 'Only ref() is supported in reference queries'
            when r.unique_id is null then concat('ref(''part_', p_partkey, ''') is ambiguous') end as problem
from part cross join (values ('m'), ('n')) v(d) left join r on r.manifest_digest = d and r.name = concat('part_', p_partkey)
""",
)
def c15(spark, sf):
    call = F.concat(F.lit("{{ ref('part_"), "p_partkey", F.lit("') }}"))
    tight = F.concat(F.lit('{{ref("part_'), "p_partkey", F.lit('")}}'))
    text = F.concat(
        F.lit("select * from "), call, F.lit(" where x = '"), "p_name",
        F.when(F.col("p_size") == 7, "{{ var('x') }}").otherwise(""),
        F.lit("' and y in (select y from "), tight, F.lit(")"),
    )
    both = F.explode(F.array(F.lit("m"), F.lit("n")))
    templates = table(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), both.alias("manifest_digest"), text.alias("text"))
    return A.render_refs(templates, B.history(spark, sf)).select("template_id", "manifest_digest", "rendered", "problem")
