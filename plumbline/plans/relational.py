"""Q: relational queries run as governed queries; their text is the same for both engines, but for those in ``ASKED``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import intervals as I
from plumbline.plans.governed import QueryRejected, Relation, governed_query
from plumbline.plans.registry import TABLES, query, table


def _relation(sf_dir: str, name: str) -> Relation:
    return Relation(
        lambda session: session.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"),
        ("c_acctbal",) if name == "customer" else (),
    )


def scope(sf_dir: str, names=TABLES):
    return {name: _relation(sf_dir, name) for name in names}


_MONEY = "cast({} as decimal(18,2))"

SQL = {
    "Q01_scan_filter_case": """
select l_orderkey, l_linenumber, l_partkey, round(l_quantity * 2, 1) as doubled,
       case when l_discount > 0.05 then 'high' when l_discount > 0 then 'low' else 'none' end as discount_band
from lineitem where l_returnflag = 'R' and l_quantity between 10 and 20""",
    "Q02_inner_join": f"""
select o.o_orderkey, c.c_name, c.c_mktsegment, {_MONEY.format('o.o_totalprice')} as price
from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderstatus = 'F'""",
    "Q02_join_using": """
select s.supp, count(*) as n
from (select s_nationkey as nat, s_suppkey as supp from supplier) s
join (select c_nationkey as nat, c_custkey from customer) c using (nat) group by s.supp""",
    "Q03_left_join": """
select c.c_custkey, count(o.o_orderkey) as n_orders
from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_orderpriority = '1-URGENT'
group by c.c_custkey""",
    "Q03_full_join": """
select coalesce(a.k, b.k) as k, a.n as n_customers, b.n as n_suppliers
from (select c_nationkey as k, count(*) as n from customer where c_mktsegment = 'BUILDING' group by c_nationkey) a
full outer join (select s_nationkey as k, count(*) as n from supplier group by s_nationkey) b on a.k = b.k""",
    "Q03_right_join": """
select n.n_name, count(s.s_suppkey) as n_suppliers
from supplier s right join nation n on s.s_nationkey = n.n_nationkey group by n.n_name""",
    "Q04_range_join": """
select o.o_orderkey, b.band
from orders o join (values (0.0, 50000.0, 'small'), (50000.0, 250000.0, 'medium'), (250000.0, 1000000.0, 'large'))
  as b(low, high, band) on o.o_totalprice >= b.low and o.o_totalprice < b.high""",
    "Q05_semi_join": """
select c_custkey, c_name from customer
where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""",
    "Q05_anti_join": """
select c_custkey, c_name from customer
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""",
    "Q06_group_by": f"""
select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, count(*) as n,
       sum({_MONEY.format('o_totalprice')}) as revenue, min(o_orderkey) as first_key
from orders group by extract(year from o_orderdate), extract(month from o_orderdate) having count(*) > 1""",
    "Q07_distinct": "select distinct l_returnflag, l_linestatus, l_tax from lineitem",
    "Q07_count_distinct": """
select l_suppkey, count(distinct l_partkey) as n_parts, count(distinct l_orderkey) as n_orders
from lineitem group by l_suppkey""",
    "Q08_rollup": """
select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus) as g
from lineitem group by rollup (l_returnflag, l_linestatus)""",
    "Q08_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "Q08_grouping_sets": f"""
select o_orderstatus, o_orderpriority, sum({_MONEY.format('o_totalprice')}) as revenue
from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())""",
    "Q09_window": f"""
select o_custkey, o_orderkey,
       row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn,
       lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous,
       sum({_MONEY.format('o_totalprice')}) over (partition by o_custkey order by o_orderdate, o_orderkey
           rows between 2 preceding and current row) as moving
from orders""",
    "Q10_top_k": f"""
select o_custkey, sum({_MONEY.format('o_totalprice')}) as revenue
from orders group by o_custkey order by revenue desc, o_custkey limit 20""",
    "Q11_union_all": "select o_custkey as k from orders union all select c_custkey from customer",
    "Q11_intersect": "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'",
    "Q11_except": "select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 300000",
    "Q11_except_all": "select o_custkey as k from orders except all select c_custkey from customer",
    "Q11_intersect_all": "select l_partkey as k from lineitem where l_returnflag = 'A' intersect all select l_partkey from lineitem where l_returnflag = 'R'",
    "Q12_cte_scalar_subquery": f"""
with totals as (select o_custkey as cust, sum({_MONEY.format('o_totalprice')}) as total, count(*) as n from orders group by o_custkey)
select t.cust, t.total from totals t
where t.n > (select avg(n) from totals)""",
    "Q13_functions": """
select o_orderkey, extract(year from o_orderdate) as y, upper(substring(o_orderpriority, 3)) as label,
       abs(round(o_totalprice / 1000, 0)) as thousands, length(o_orderpriority) as len,
       concat(o_orderstatus, '-', cast(o_custkey as varchar(20))) as tag
from orders where o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1997-01-01 00:00:00'""",
}


# What Spark is asked where it would otherwise form every pair only to count it: customers are counted by nation before they are joined.
ASKED = {
    "Q02_join_using": """
select s.supp, sum(c.n) as n
from (select s_nationkey as nat, s_suppkey as supp from supplier) s
join (select c_nationkey as nat, count(*) as n from customer group by c_nationkey) c using (nat) group by s.supp""",
}


def _register(name: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf, sql=ASKED.get(name, sql)):
        return governed_query(spark, scope(sf), sql, max_rows=None)


for _name, _sql in SQL.items():
    _register(_name, _sql)


@query(
    "C01_governed_query",
    "select c_mktsegment, count(*) as n from customer group by c_mktsegment",
)
def c01(spark, sf):
    sql = "select c_mktsegment, count(*) as n from customer group by c_mktsegment"
    return governed_query(spark, scope(sf, ["customer"]), sql, max_rows=1000)


@query("C10_hidden_columns", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def c10(spark, sf):
    return governed_query(spark, scope(sf, ["customer"]), "select * from customer", max_rows=None)


_NEWEST = "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey"


@query("C11_row_cap", f"{_NEWEST} limit 50")
def c11(spark, sf):
    return governed_query(spark, scope(sf, ["orders"]), f"{_NEWEST} limit 5000", max_rows=50)


# What happened within ten minutes after each error, whoever did it; the spells of users that overlap with one of another user.
@query(
    "Q04_event_windows",
    """
select e.event_id as error_id, o.event_id as other_id, o.event_type
from events e join events o on o.ts >= e.ts and o.ts < e.ts + interval 10 minute and o.event_id <> e.event_id
where e.event_type = 'error'
""",
)
def q04_windows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", I.seconds("ts").alias("low"))
    windows = events.where("event_type = 'error'").withColumn("high", F.col("low") + 600)
    met = I.overlap_join(windows, events, (), ("low", "high"), ("low", "low"))
    return met.where("left.event_id <> right.event_id").select(
        F.col("left.event_id").alias("error_id"), F.col("right.event_id").alias("other_id"), F.col("right.event_type").alias("event_type"))


# A spell lasts as many seconds as its event's value, from a second to minutes.
@query(
    "Q04_overlapping_spells",
    """
with s as (select event_id, event_type, ts, ts + to_microseconds(cast(round(value * 1000000) as bigint)) as until from events)
select a.event_id as first_id, b.event_id as second_id, a.event_type
from s a join s b on a.event_type = b.event_type and a.event_id < b.event_id and a.ts < b.until and b.ts < a.until
""",
)
def q04_spells(spark, sf):
    spells = table(spark, sf, "events").select(
        "event_id", "event_type", I.seconds("ts").alias("low"), ((F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long")) / 1e6).alias("high"))
    met = I.overlap_join(spells, spells, ["event_type"])
    return met.where("left.event_id < right.event_id").select(
        F.col("left.event_id").alias("first_id"), F.col("right.event_id").alias("second_id"), F.col("left.event_type").alias("event_type"))


# Texts and whether a governed query over customer, orders and nation accepts them.
VERDICTS = {
    "plain": (True, "select c_custkey, c_name from customer"),
    "call_in_a_literal": (True, "select c_custkey, 'see read_csv (docs)' as t from customer"),
    "common_table_over_scope": (True, "with big as (select * from orders where o_totalprice > 300000) select o_orderkey from big"),
    "common_table_hides_relation": (False, "with customer as (select 5 as z) select * from customer"),
    "alias_like_relation": (False, "select * from (select 7 as z) customer"),
    "table_function": (False, "select customer.id from range(3) customer"),
    "explicit_cross_join": (False, "select c_custkey, n_name from customer cross join nation"),
    "implicit_cross_join": (False, "select c_custkey, n_name from customer, nation"),
    "joined": (True, "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"),
    "cross_join_of_constants": (True, "select c_custkey, f from customer cross join (values (1), (2)) as v(f)"),
    "subquery_in_a_filter": (True, "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)"),
    "out_of_scope_in_a_filter": (False, "select c_custkey from customer where c_custkey in (select s_suppkey from supplier)"),
    "forbidden_function_in_a_filter": (False, "select c_custkey from customer where reflect('java.lang.Math', 'abs', -1) = '1'"),
    "hidden_column": (False, "select c_acctbal from customer"),
    "write": (False, "delete from customer"),
    "two_statements": (False, "select 1 from customer); drop view customer; select (1"),
}


@query(
    "C01_verdicts",
    "\nunion all ".join(
        f"select '{name}' as name, true as accepted, count(*) as n_rows from ({sql}) t" if accepted
        else f"select '{name}', false, cast(null as bigint)" for name, (accepted, sql) in VERDICTS.items()),
)
def c01_verdicts(spark, sf):
    """Each text is decided on its plans; what is accepted is counted."""
    rows = []
    for name, (_, sql) in VERDICTS.items():
        try:
            result = governed_query(spark, scope(sf, ["customer", "orders", "nation"]), sql, max_rows=None)
        except QueryRejected:
            rows.append(f"select '{name}' as name, false as accepted, cast(null as bigint) as n_rows")
            continue
        rows.append(result.agg(F.lit(name).alias("name"), F.lit(True).alias("accepted"), F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionAll, [spark.sql(r) if isinstance(r, str) else r for r in rows])
