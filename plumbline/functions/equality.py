"""Typed cells and the equality contract between result values.

A cell is ``struct<kind, num, str>``: results of different queries have different column types, so
values are compared by kind instead of relying on implicit casts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = "struct<kind:string,num:double,str:string>"
NULL_CELL_SQL = f"cast(named_struct('kind', 'null', 'num', null, 'str', null) as {CELL})"


def _fields(value: Column, dtype: T.DataType) -> tuple[str, Column, Column]:
    no_num, no_str = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, T.BooleanType):
        return "bool", value.cast("double"), no_str
    if isinstance(dtype, T.NumericType):
        return "num", value.cast("double"), no_str
    if isinstance(dtype, T.DateType):
        return "temporal", no_num, F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return "temporal", no_num, F.when(micros == "000000", whole).otherwise(
            F.concat(whole, F.lit("."), micros)
        )
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "str", no_num, value.cast("string")
    return "json", no_num, F.to_json(value)


def typed_cell(value: Column, dtype: T.DataType, name: str | None = None) -> Column:
    """Value of a known type as a cell (with its column name when given); NULL becomes kind 'null'."""
    kind, num, text = _fields(value, dtype)
    parts = [
        F.when(value.isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("kind"),
        num.alias("num"),
        text.alias("str"),
    ]
    if name is not None:
        parts.insert(0, F.lit(name).alias("col"))
    return F.struct(*parts)


def number_equal(left: Column, right: Column, tolerance: Column) -> Column:
    """Absolute tolerance; infinities equal themselves and NaN equals nothing."""
    return (
        ~F.isnan(left)
        & ~F.isnan(right)
        & ((left == right) | (F.abs(left - right) <= tolerance))
    )


def cell_equal(left: Column, right: Column, tolerance: Column | float) -> Column:
    """Never NULL.

    Numbers use the tolerance. Dates and timestamps are compared by their text, also with plain
    strings. A boolean equals a number exactly (true = 1). Everything else needs the same kind.
    """
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    lk, rk = left["kind"], right["kind"]
    textual, numeric = ("temporal", "str"), ("num", "bool")
    return (
        F.when((lk == "num") & (rk == "num"), number_equal(left["num"], right["num"], tolerance))
        .when(lk.isin(*textual) & rk.isin(*textual), left["str"] == right["str"])
        .when(
            lk.isin(*numeric) & rk.isin(*numeric),
            ~F.isnan(left["num"]) & ~F.isnan(right["num"]) & (left["num"] == right["num"]),
        )
        .otherwise(lk.eqNullSafe(rk) & left["str"].eqNullSafe(right["str"]))
    )


def cell_key(cell: Column) -> Column:
    """Grouping key under which cells are equal at tolerance zero (NaN has to be tested apart)."""
    kind = cell["kind"]
    return F.struct(
        F.when(kind.isin("num", "bool"), "n")
        .when(kind.isin("temporal", "str"), "s")
        .otherwise(kind)
        .alias("class"),
        cell["num"].alias("num"),
        cell["str"].alias("str"),
    )


def has_nan(cells: Column) -> Column:
    return F.exists(cells, lambda c: (c["kind"] == "num") & F.isnan(c["num"]))


def cell_text(cell: Column) -> Column:
    """Readable form for messages: whole numbers without decimals, NULL as 'null'."""
    num = cell["num"]
    return (
        F.when(cell["kind"] == "null", "null")
        .when(cell["kind"] == "bool", F.when(num == 1, "true").otherwise("false"))
        .when(
            (cell["kind"] == "num") & (F.abs(num) < 1e15) & (num == F.floor(num)),
            num.cast("bigint").cast("string"),
        )
        .when(cell["kind"] == "num", num.cast("string"))
        .otherwise(cell["str"])
    )


def row_key(cells: Column) -> list[Column]:
    """Two 64-bit hashes ``key_a, key_b`` over a row's names and cell keys, in name order.

    Rows that are equal at tolerance zero share them.
    """
    keyed = F.transform(
        F.array_sort(cells), lambda c: F.struct(c["col"].alias("col"), cell_key(c).alias("key"))
    )
    return key128(keyed)


def key128(*parts: Column | str) -> list[Column]:
    """Two 64-bit hashes of the same values, seeded apart: a narrow grouping key."""
    return [
        F.xxhash64(F.lit(1), *parts).alias("key_a"),
        F.xxhash64(F.lit(2), *parts).alias("key_b"),
    ]


def bucket(num: Column, width: Column) -> Column:
    """Index of the bucket of the given width as a DOUBLE, monotone in ``num`` and exact for large values.

    Multiples of the width lie in the middle of their buckets.
    """
    place = num / width + 0.5
    # beyond exact integers neighbouring doubles are further apart than the width: each its own bucket
    return F.when(F.abs(place) < 9e15, F.floor(place).cast("double")).otherwise(num * 2.0**100)
