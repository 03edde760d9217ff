"""D: result comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.equality import CELL, cell_equal, typed_cell
from plumbline.operators import cells as C
from plumbline.operators import compare as K
from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, table, view


_ORDER_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderstatus"]


def _orders(spark, sf, sql, columns=_ORDER_COLUMNS, rename=None):
    df = view(spark, sf, sql)
    if rename:
        df = df.withColumnsRenamed(rename)
        columns = [rename.get(c, c) for c in columns]
    order = [(rename or {}).get(c, c) for c in fx.ORDER_POSITION]
    return C.to_rows(df, "cmp_id", order_by=order, columns=columns)


def _sides(spark, sf):
    return _orders(spark, sf, fx.ACTUAL_ROWS), _orders(spark, sf, fx.EXPECTED_ROWS)


def _lines(spark, sf, sql, columns, ordered=True):
    """Rows of orders' lines; where positions do not matter the line number stands in for one."""
    df = view(spark, sf, sql)
    if ordered:
        return C.to_rows(df, "cmp_id", order_by=fx.LINE_POSITION, columns=columns)
    return C.to_rows(df, "cmp_id", row_idx="l_linenumber", columns=columns)


def _rows(spark, sf, sql):
    return C.to_rows(view(spark, sf, sql), "cmp_id", row_idx="row_idx")


@query(
    "D01_cells",
    """
with r as (select o_custkey as cmp_id,
                  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as row_idx,
                  o_orderkey, o_totalprice, o_orderstatus, o_orderdate from orders)
select cmp_id, row_idx, 0 as col_idx, 'o_orderkey' as col, 'num' as kind,
       cast(o_orderkey as double) as num, cast(null as varchar) as str from r
union all select cmp_id, row_idx, 1, 'o_totalprice', 'num', o_totalprice, null from r
union all select cmp_id, row_idx, 2, 'o_orderstatus', 'str', null, o_orderstatus from r
union all select cmp_id, row_idx, 3, 'o_orderdate', 'temporal', null,
                 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') from r
""",
)
def d01(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"
    )
    return C.to_cells(C.to_rows(orders, "o_custkey", order_by=["o_orderdate", "o_orderkey"]))


@query(
    "D02_cell_equal",
    """
select l_returnflag, l_discount, count(*) as n,
       count(*) filter (where abs(l_extendedprice - l_extendedprice * (1 - l_discount)) <= 50.0) as n_equal
from lineitem group by l_returnflag, l_discount
""",
)
def d02(spark, sf):
    from pyspark.sql.types import DoubleType

    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    equal = cell_equal(
        typed_cell(F.col("l_extendedprice"), DoubleType()), typed_cell(net, DoubleType()), 50.0
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_discount")
        .agg(F.count("*").alias("n"), F.count_if(equal).alias("n_equal"))
    )


_TOTALS = "select o_custkey as cmp_id, 0 as row_idx, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_custkey"
_WANTED_TOTALS = f"""
select o_custkey as cmp_id, 0 as row_idx,
       sum(cast(o_totalprice as decimal(18,2))) + max(case when o_totalprice > 495000 then 1 else 0 end) as total
from orders group by o_custkey
"""


@query(
    "D03_scalar",
    f"""
select a.cmp_id, abs(cast(a.total as double) - cast(e.total as double)) <= 0.5 as passed,
       cast(1 as bigint) as n_actual, cast(1 as bigint) as n_expected
from ({_TOTALS}) a join ({_WANTED_TOTALS}) e on a.cmp_id = e.cmp_id
""",
)
def d03(spark, sf):
    verdicts = K.compare_scalar(_rows(spark, sf, _TOTALS), _rows(spark, sf, _WANTED_TOTALS), 0.5)
    return verdicts.drop("message")


_ORDERED_ORACLE = f"""
select coalesce(a.cmp_id, e.cmp_id) as cmp_id,
       bool_and(coalesce(a.o_orderkey = e.o_orderkey and abs(a.o_totalprice - e.o_totalprice) <= 0.01
                         and a.o_orderstatus = e.o_orderstatus, false)) as passed,
       count(a.row_idx) as n_actual, count(e.row_idx) as n_expected
from ({fx.ACTUAL}) a full join ({fx.EXPECTED}) e on a.cmp_id = e.cmp_id and a.row_idx = e.row_idx
group by 1
"""


@query("D04_ordered", _ORDERED_ORACLE)
def d04(spark, sf):
    return K.compare_ordered(*_sides(spark, sf), 0.01)


@query("D05_ordered_values", _ORDERED_ORACLE)
def d05(spark, sf):
    names = {"o_orderkey": "key", "o_totalprice": "price", "o_orderstatus": "status"}
    return K.compare_ordered_values(
        _orders(spark, sf, fx.ACTUAL_ROWS), _orders(spark, sf, fx.EXPECTED_ROWS, rename=names), 0.01
    )


_LINE_COUNTS = """
with a as (select l_orderkey as cmp_id, l_linenumber, l_partkey, l_returnflag, l_quantity, count(*) as n
           from lineitem group by all),
     e as (select l_orderkey as cmp_id, l_linenumber, l_partkey,
                  case when l_discount = 0.1 and l_tax = 0.08 then 'X' else l_returnflag end as l_returnflag,
                  l_quantity, count(*) as n
           from lineitem group by all)
select coalesce(a.cmp_id, e.cmp_id) as cmp_id,
       bool_and(coalesce(a.n, 0) = coalesce(e.n, 0)) as passed,
       cast(coalesce(sum(a.n), 0) as bigint) as n_actual,
       cast(coalesce(sum(e.n), 0) as bigint) as n_expected
from a full join e
  on a.cmp_id = e.cmp_id and a.l_linenumber = e.l_linenumber and a.l_partkey = e.l_partkey
 and a.l_returnflag = e.l_returnflag and a.l_quantity = e.l_quantity
group by 1
"""


@query("D06_unordered", _LINE_COUNTS)
def d06(spark, sf):
    columns = ["l_linenumber", "l_partkey", "l_returnflag", "l_quantity"]
    a = _lines(spark, sf, fx.LINES_ROWS, columns, ordered=False)
    e = _lines(spark, sf, fx.LINES_EXPECTED_ROWS, columns, ordered=False)
    return K.compare_unordered(a, e)


_TOLERANT_COLUMNS = ["l_partkey", "l_returnflag", "l_extendedprice"]


def _tolerant_sides(spark, sf, ordered):
    sides = (fx.LINES_ROWS, fx.LINES_EXPECTED_ROWS)
    return [_lines(spark, sf, sql, _TOLERANT_COLUMNS, ordered) for sql in sides]


@query(
    "D07_unordered_tolerant",
    f"""
with a as (select *, row_number() over (partition by cmp_id, l_partkey, l_returnflag order by l_extendedprice) as rk
           from ({fx.LINES}) t),
     e as (select *, row_number() over (partition by cmp_id, l_partkey, l_returnflag order by l_extendedprice) as rk
           from ({fx.LINES_EXPECTED}) t)
select coalesce(a.cmp_id, e.cmp_id) as cmp_id,
       bool_and(coalesce(abs(a.l_extendedprice - e.l_extendedprice) <= 0.01, false)) as passed,
       count(a.cmp_id) as n_actual, count(e.cmp_id) as n_expected
from a full join e on a.cmp_id = e.cmp_id and a.l_partkey = e.l_partkey
                  and a.l_returnflag = e.l_returnflag and a.rk = e.rk
group by 1
""",
)
def d07(spark, sf):
    return K.compare_unordered_tolerant(*_tolerant_sides(spark, sf, ordered=False), 0.01)


_NEAR = "a.l_partkey = e.l_partkey and a.l_returnflag = e.l_returnflag and abs(a.l_extendedprice - e.l_extendedprice) <= 0.01"


@query(
    "D07_unordered_greedy",
    f"""
with recursive a as (select * from ({fx.LINES}) t), e as (select * from ({fx.LINES_EXPECTED}) t),
     near as (select a.cmp_id, a.row_idx, list(e.row_idx order by e.row_idx) as js
              from a join e on a.cmp_id = e.cmp_id and {_NEAR} group by 1, 2),
     walk as (
       select distinct cmp_id, 0::bigint as row_idx, []::bigint[] as taken, true as ok from a
       union all
       select w.cmp_id, w.row_idx + 1, list_append(w.taken, list_filter(js, lambda j: not list_contains(w.taken, j))[1]),
              w.ok and len(list_filter(coalesce(js, []), lambda j: not list_contains(w.taken, j))) > 0
       from walk w join a using (cmp_id, row_idx) left join near using (cmp_id, row_idx))
select coalesce(x.cmp_id, y.cmp_id) as cmp_id, coalesce(ok and n_actual = n_expected, false) as passed,
       coalesce(n_actual, 0) as n_actual, coalesce(n_expected, 0) as n_expected
from (select cmp_id, count(*) as n_actual from a group by 1) x full join (select cmp_id, count(*) as n_expected from e group by 1) y using (cmp_id)
left join walk w on w.cmp_id = x.cmp_id and w.row_idx = n_actual
""",
)
def d07_greedy(spark, sf):
    return K.compare_unordered_tolerant(*_tolerant_sides(spark, sf, ordered=True), 0.01, match="greedy")


# Three small numbers per line; a tolerance of two makes most lines of an order near each other. Some expected ones move further.
_SMALL = "select l_orderkey as cmp_id, l_linenumber as place, cast(l_linenumber as double) as line, l_quantity as amount, round(l_tax * 100) as tax from lineitem"
_SMALL_EXPECTED = """
select l_orderkey as cmp_id, l_linenumber as place, cast(l_linenumber as double) + l_partkey % 3 - 1 as line,
       l_quantity + case when l_discount = 0.1 then 3 else l_suppkey % 5 - 2 end as amount,
       round(l_tax * 100) + l_suppkey % 3 as tax
from lineitem
"""


@query(
    "D07_unordered_columns",
    f"""
with a as (select *, row_number() over (partition by cmp_id order by line, amount, tax) as i from ({_SMALL}) t),
     e as (select *, row_number() over (partition by cmp_id order by line, amount, tax) as j from ({_SMALL_EXPECTED}) t),
     n as (select cmp_id, count(*) as n from a group by 1),
     near as (select a.cmp_id, a.i, bit_or(1 << (e.j - 1)) as m
              from a join e on a.cmp_id = e.cmp_id and abs(a.line - e.line) <= 2 and abs(a.amount - e.amount) <= 2 and abs(a.tax - e.tax) <= 2
              group by 1, 2),
     subsets as (select cmp_id, n, unnest(range(1, 1 << n)) as s from n),
     reached as (select s.cmp_id, s.s, bit_count(s.s) as wanted, bit_count(bit_or(coalesce(near.m, 0))) as got
                 from subsets s join range(0, 16) r(i) on (s.s >> r.i) & 1 = 1
                 left join near on near.cmp_id = s.cmp_id and near.i = r.i + 1 group by 1, 2)
select cmp_id, bool_and(got >= wanted) as passed, any_value(n) as n_actual, any_value(n) as n_expected from reached join n using (cmp_id) group by 1
""",
)
def d07_columns(spark, sf):
    sides = [C.to_rows(view(spark, sf, sql), "cmp_id", row_idx="place") for sql in (_SMALL, _SMALL_EXPECTED)]
    return K.compare_unordered_tolerant(*sides, 2.0)


_KEYED_EXPECTED = f"select cmp_id, row_idx, l_linenumber, l_partkey, l_extendedprice from ({fx.LINES_EXPECTED}) t"
_KEYED_ACTUAL = f"select cmp_id, row_idx, l_linenumber, l_partkey, l_extendedprice from ({fx.LINES}) t"


@query(
    "D08_keyed",
    f"""
with a as (select *, row_number() over (partition by cmp_id order by l_linenumber, l_partkey, row_idx) as rk
           from ({_KEYED_ACTUAL}) t),
     e as (select *, row_number() over (partition by cmp_id order by l_linenumber, l_partkey, row_idx) as rk
           from ({_KEYED_EXPECTED}) t)
select coalesce(a.cmp_id, e.cmp_id) as cmp_id,
       bool_and(coalesce(a.l_linenumber = e.l_linenumber and a.l_partkey = e.l_partkey
                         and abs(a.l_extendedprice - e.l_extendedprice) <= 0.01, false)) as passed,
       count(a.rk) as n_actual, count(e.rk) as n_expected
from a full join e on a.cmp_id = e.cmp_id and a.rk = e.rk
group by 1
""",
)
def d08(spark, sf):
    columns = ["l_linenumber", "l_partkey", "l_extendedprice"]
    return K.compare_keyed(
        _lines(spark, sf, fx.LINES_ROWS, columns),
        _lines(spark, sf, fx.LINES_EXPECTED_ROWS, columns),
        ["l_linenumber", "l_partkey"],
        0.01,
    )


@query(
    "D09_allow_extra",
    f"""
select coalesce(a.cmp_id, e.cmp_id) as cmp_id,
       bool_and(coalesce(a.o_orderkey = e.o_orderkey and abs(a.o_totalprice - e.o_totalprice) <= 0.01, false))
           as passed,
       count(a.row_idx) as n_actual, count(e.row_idx) as n_expected
from ({fx.ACTUAL}) a full join ({fx.EXPECTED}) e on a.cmp_id = e.cmp_id and a.row_idx = e.row_idx
group by 1
""",
)
def d09(spark, sf):
    return K.compare_ordered(
        _orders(spark, sf, fx.ACTUAL_ROWS),
        _orders(spark, sf, fx.EXPECTED_ROWS, columns=["o_totalprice", "o_orderkey"]),
        0.01,
        allow_extra=True,
    )


@query(
    "D10_row_count",
    """
select c_custkey as cmp_id, 'row_count' as name, coalesce(a.n, 0) = coalesce(e.n, 0) as passed,
       concat('expected ', coalesce(e.n, 0), ', got ', coalesce(a.n, 0)) as message
from customer
left join (select o_custkey, count(*) as n from orders group by 1) a on c_custkey = a.o_custkey
left join (select o_custkey, count(*) as n from orders where o_totalprice >= 2500 group by 1) e
  on c_custkey = e.o_custkey
""",
)
def d10(spark, sf):
    expected = view(spark, sf, fx.EXPECTED_ROWS).groupBy("cmp_id").agg(F.count("*").alias("n"))
    wanted = (
        table(spark, sf, "customer")
        .select(F.col("c_custkey").alias("cmp_id"))
        .join(expected, "cmp_id", "left")
        .select("cmp_id", F.coalesce("n", F.lit(0)).alias("row_count"))
    )
    return K.check_row_count(view(spark, sf, fx.ACTUAL_ROWS), wanted)


@query(
    "D11_shape",
    """
select c_custkey as cmp_id, 'shape' as name,
       c_mktsegment <> 'BUILDING' and c_custkey in (select o_custkey from orders) as passed,
       concat('expected ', case when c_mktsegment = 'BUILDING' then 'o_orderkey, o_totalprice'
                                else 'o_orderkey, o_orderstatus, o_totalprice' end,
              '; got ', case when c_custkey in (select o_custkey from orders)
                             then 'o_orderkey, o_orderstatus, o_totalprice' else '' end) as message
from customer
""",
)
def d11(spark, sf):
    names = F.when(
        F.col("c_mktsegment") == "BUILDING", F.array(F.lit("o_totalprice"), F.lit("o_orderkey"))
    ).otherwise(F.array(F.lit("o_totalprice"), F.lit("o_orderkey"), F.lit("o_orderstatus")))
    wanted = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cmp_id"), names.alias("columns")
    )
    return K.check_shape(_orders(spark, sf, fx.ACTUAL_ROWS), wanted)


@query(
    "D12_diff_rows",
    f"""
select * from (
  select coalesce(a.cmp_id, e.cmp_id) as cmp_id, count(a.row_idx) as n_actual, count(e.row_idx) as n_expected,
         min(coalesce(a.row_idx, e.row_idx)) filter (where not coalesce(
             a.o_orderkey = e.o_orderkey and abs(a.o_totalprice - e.o_totalprice) <= 0.01
             and a.o_orderstatus = e.o_orderstatus, false)) as first_row
  from ({fx.ACTUAL}) a full join ({fx.EXPECTED}) e on a.cmp_id = e.cmp_id and a.row_idx = e.row_idx
  group by 1) t
where first_row is not null
""",
)
def d12_rows(spark, sf):
    found = K.diff_rows(*_sides(spark, sf), 0.01)
    return found.select("cmp_id", "n_actual", "n_expected", F.col("first_row").cast("bigint").alias("first_row"))


@query(
    "D12_diff_keys",
    """
with lone as (select o_custkey as cmp_id, o_orderkey,
                     row_number() over (partition by o_custkey order by o_orderkey) as pos
              from orders where o_totalprice < 2500)
select cmp_id, 'unexpected' as kind, count(*) as n_keys,
       string_agg(cast(o_orderkey as varchar), ', ' order by o_orderkey) filter (where pos <= 5) as keys
from lone group by cmp_id
""",
)
def d12_keys(spark, sf):
    return K.diff_keys(*_sides(spark, sf), ["o_orderkey"])


@query(
    "D13_expected_side",
    """
with c as (select c_custkey as cmp_id,
                  case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'reference'
                       when c_mktsegment = 'FURNITURE' then 'rows'
                       when c_mktsegment = 'HOUSEHOLD' then 'value' else 'none' end as source,
                  c_mktsegment <> 'MACHINERY' as reference_ok, c_acctbal from customer),
     r as (select o_custkey, count(*) as n, count(*) filter (where o_totalprice >= 2500) as n_literal
           from orders group by 1)
select cmp_id, source, source <> 'none' as checked, reference_ok,
       cast(case when source = 'reference' and reference_ok then coalesce(n, 0)
                 when source = 'rows' then coalesce(n_literal, 0) else 0 end as bigint) as n_rows,
       case when source = 'value' then c_acctbal end as value
from c left join r on cmp_id = o_custkey
""",
)
def d13(spark, sf):
    segment = F.col("c_mktsegment")
    value = F.struct(
        F.lit("num").alias("kind"),
        F.col("c_acctbal").alias("num"),
        F.lit(None).cast("string").alias("str"),
    ).cast(CELL)
    cases = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cmp_id"),
        segment.isin("BUILDING", "MACHINERY").alias("has_reference"),
        (segment == "MACHINERY").alias("reference_failed"),
        (segment == "FURNITURE").alias("has_rows"),
        (segment == "HOUSEHOLD").alias("has_value"),
        value.alias("value"),
    )
    chosen = C.choose_expected(cases, *_sides(spark, sf))
    return chosen.groupBy("cmp_id", "source", "checked", "reference_ok").agg(
        F.count("row_idx").alias("n_rows"), F.max("value.num").alias("value")
    )
