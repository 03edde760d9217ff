"""Inputs of the registered queries: views over the base tables, in SQL both engines read alike.

Positions within a result are numbered by windows in the SQL twins only. On Spark the unnumbered
form of a view goes through ``ranked``, which keeps a result holding most of the rows parallel.
"""

# Result rows of one comparison per customer.
ACTUAL_ROWS = """
select o_custkey as cmp_id, o_orderdate, o_orderkey, o_totalprice, o_orderstatus from orders
"""
# The same results with rows lost, small changes within a tolerance of 0.01 and large ones beyond it.
EXPECTED_ROWS = """
select o_custkey as cmp_id, o_orderdate, o_orderkey,
       o_totalprice + case when o_totalprice > 495000 then 5.0
                           when o_orderpriority = '5-LOW' then 0.004 else 0.0 end as o_totalprice,
       o_orderstatus
from orders where o_totalprice >= 2500
"""
ORDER_POSITION = ["o_orderdate", "o_orderkey"]
_NUMBERED = """
select cmp_id, row_number() over (partition by cmp_id order by o_orderdate, o_orderkey) - 1 as row_idx,
       o_orderkey, o_totalprice, o_orderstatus
from ({rows}) t
"""
ACTUAL = _NUMBERED.format(rows=ACTUAL_ROWS)
EXPECTED = _NUMBERED.format(rows=EXPECTED_ROWS)

# Line items as results, one comparison per order.
LINES_ROWS = """
select l_orderkey as cmp_id, l_shipdate, l_suppkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
       l_extendedprice
from lineitem
"""
# The same lines; some prices and flags differ, others differ within a tolerance of 0.01.
LINES_EXPECTED_ROWS = """
select l_orderkey as cmp_id, l_shipdate, l_suppkey, l_linenumber, l_partkey,
       case when l_discount = 0.1 and l_tax = 0.08 then 'X' else l_returnflag end as l_returnflag,
       l_quantity,
       l_extendedprice + case when l_tax = 0.0 and l_discount = 0.0 then 3.0
                              when l_tax = 0.01 then 0.004 else 0.0 end as l_extendedprice
from lineitem
"""
LINE_POSITION = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]
_NUMBERED_LINES = """
select cmp_id, row_number() over (partition by cmp_id
                                  order by l_shipdate, l_partkey, l_suppkey, l_linenumber) - 1 as row_idx,
       l_linenumber, l_partkey, l_returnflag, l_quantity, l_extendedprice
from ({rows}) t
"""
LINES = _NUMBERED_LINES.format(rows=LINES_ROWS)
LINES_EXPECTED = _NUMBERED_LINES.format(rows=LINES_EXPECTED_ROWS)

# One answer per customer; claims about rich orders are wrong by one.
ANSWERS = """
select trace_id, n_orders, total, top_status, top,
       concat('How much did customer ', cast(trace_id as varchar(20)), ' order?') as question,
       concat('Customer ', cast(trace_id as varchar(20)), ' placed ', cast(n_orders as varchar(20)),
              ' orders totalling $',
              cast(total + case when top > 490000 then 1 else 0 end as varchar(40)),
              ' and mostly ', case when top < 480000 then top_status else 'unknown' end, '.') as claim_text
from (select o_custkey as trace_id, count(*) as n_orders,
             sum(cast(o_totalprice as decimal(18,2))) as total,
             max(o_totalprice) as top,
             concat('status ', max(o_orderstatus)) as top_status
      from orders group by o_custkey) t
"""

# Run log: one record per event.
RUNS = """
select event_id as trace_id, concat('agent_', cast(user_id % 20 as varchar(20))) as agent,
       event_type as case_name, event_type <> 'error' as passed, value as latency_ms,
       ts as created_at, props
from events
"""

# Acyclic lineage of depth three.
EDGES = """
select concat('region.', cast(n_regionkey as varchar(20))) as parent_id,
       concat('nation.', cast(n_nationkey as varchar(20))) as child_id from nation
union all select concat('nation.', cast(c_nationkey as varchar(20))),
                 concat('customer.', cast(c_custkey as varchar(20))) from customer
union all select concat('customer.', cast(o_custkey as varchar(20))),
                 concat('order.', cast(o_orderkey as varchar(20))) from orders
"""

# Every vertex of the lineage as a resource; nations are sources, small customers are ephemeral.
GRAPH_RESOURCES = """
select concat('region.', cast(r_regionkey as varchar(20))) as unique_id, 'model' as resource_type,
       'table' as materialized, true as enabled from region
union all select concat('nation.', cast(n_nationkey as varchar(20))), 'source', null, true from nation
union all select concat('customer.', cast(c_custkey as varchar(20))), 'model',
                 case when c_acctbal < 0 then 'ephemeral' else 'view' end, true from customer
union all select concat('order.', cast(o_orderkey as varchar(20))), 'model', 'table',
                 o_orderpriority <> '1-URGENT' from orders
"""

# Catalog resources.
RESOURCES = """
select concat('model.', lower(p_type), '.part_', cast(p_partkey as varchar(20))) as unique_id,
       case when p_size >= 49 then 'source' else 'model' end as resource_type,
       lower(p_type) as package,
       concat('part_', cast(p_partkey as varchar(20))) as name,
       concat('A_', cast(p_partkey - case when p_size = 42 then 1 else 0 end as varchar(20)))
           as alias,
       'db' as database, 'main' as schema,
       concat('"db"."main"."a_', cast(p_partkey as varchar(20)), '"') as relation_name,
       p_brand as grp, replace(p_name, ' ', '_') as tag,
       concat('models/', p_brand, '/', lower(p_type), '/p', cast(p_partkey as varchar(20)), '.sql') as path,
       case when p_size between 20 and 24 then 'ephemeral' when p_size < 10 then null else 'table' end
           as materialized,
       p_size not in (13, 26, 39) as enabled,
       case when p_size between 40 and 44 then '' else p_name end as description
from part
"""

# Two snapshots of that catalog: the second one has renamed some resources and removed others.
_SNAPSHOT_COLUMNS = "resource_type, package, {name} as name, {alias} as alias, database, schema, {relation} as relation_name, grp, tag, path, materialized, enabled, description"
RESOURCE_HISTORY = f"""
select 'm' as manifest_digest, unique_id, {_SNAPSHOT_COLUMNS.format(name='name', alias='alias', relation='relation_name')} from ({RESOURCES}) r
union all
select 'n', unique_id, {_SNAPSHOT_COLUMNS.format(
    name="case when unique_id like '%7' then concat('new_', name) else name end",
    alias="case when unique_id like '%7' then concat('New_', alias) else alias end",
    relation="case when unique_id like '%7' then replace(relation_name, '.\"a_', '.\"new_a_') else relation_name end")}
from ({RESOURCES}) r where unique_id not like '%3'
"""
# Agents and the snapshots they have known, by the time these came into force. Some queries are older than all of them.
SNAPSHOTS = """
select 'all' as agent, 'm' as manifest_digest, cast('1995-03-01' as timestamp) as since
union all select 'all', 'n', cast('1996-08-01 00:00:00' as timestamp)
"""
# Queries and when they ran.
QUERY_LOG = """
select l_orderkey as query_id, 'all' as agent, min(l_shipdate) as ran_at from lineitem group by l_orderkey
"""
# The same with the snapshot in force.
QUERY_DIGESTS = f"""
select query_id, agent, case when ran_at >= cast('1996-08-01' as timestamp) then 'n' when ran_at >= cast('1995-03-01' as timestamp) then 'm' end as manifest_digest
from ({QUERY_LOG}) q
"""

# Relation references of a query log: quoted, qualified, ambiguous and unknown.
RELATION_ROWS = """
select l_orderkey as query_id, l_partkey, l_suppkey, l_shipdate,
       case when l_returnflag = 'A' then concat('"DB".main.a_', cast(l_partkey as varchar(20)))
            when l_returnflag = 'N' then concat('part_', cast(l_partkey as varchar(20)))
            when l_linestatus = 'O' and l_quantity > 48 then 'missing_table'
            else concat('a_', cast(l_partkey as varchar(20))) end as ref
from lineitem
"""
RELATION_POSITION = ["l_partkey", "l_suppkey", "l_shipdate"]
RELATIONS = f"""
select query_id, row_number() over (partition by query_id order by l_partkey, l_suppkey, l_shipdate) as ord,
       l_partkey, ref
from ({RELATION_ROWS}) t
"""

QUESTIONS = "select conv_id, turn, text as question from conversations where role = 'user'"

# Approved cases: the questions of long conversations, spaced and cased differently.
APPROVED = """
select conv_id as case_id, turn as case_turn,
       concat('  ', lower(replace(text, ' ', '  ')), ' ') as question
from conversations
where role = 'user' and conv_id in (select conv_id from conversations where turn >= 5)
"""
