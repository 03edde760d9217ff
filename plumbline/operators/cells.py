"""Results as typed rows: one record per result row, holding its cells in column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.equality import cell_key, key128, typed_cell
from plumbline.operators.ranking import HOT_ROWS, ranked

def to_rows(
    df: DataFrame,
    cmp_id: str,
    order_by: Sequence[str] | None = None,
    row_idx: str | None = None,
    columns: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Result rows ``(cmp_id, row_idx, cells, key_a, key_b, nan)`` of many comparisons in one table.

    ``row_idx`` names a recorded position. Without one it is derived from ``order_by``. The keys are
    those of ``equality.row_key``; here the columns are known, so they are plain compiled hashes.
    """
    if (row_idx is None) == (order_by is None):
        raise ValueError("give either order_by or row_idx")
    names = list(columns) if columns else [c for c in df.columns if c not in (cmp_id, row_idx)]
    types = {f.name: f.dataType for f in df.schema.fields}
    if row_idx is None:
        needed = dict.fromkeys([cmp_id, *order_by, *names])
        df = ranked(df.select(*needed), [cmp_id], list(order_by), "_row_idx", hot_rows)
        row_idx = "_row_idx"
    parts, nan = [], F.lit(False)
    for c in sorted(names):
        parts += [F.lit(c), cell_key(typed_cell(F.col(c), types[c]))]
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            nan = nan | F.isnan(F.col(c))
    return df.select(
        F.col(cmp_id).alias("cmp_id"),
        F.col(row_idx).cast("bigint").alias("row_idx"),
        F.array(*[typed_cell(F.col(c), types[c], c) for c in names]).alias("cells"),
        *key128(*parts),
        nan.alias("nan"),
    )


def to_cells(rows: DataFrame) -> DataFrame:
    """Long form ``(cmp_id, row_idx, col_idx, col, kind, num, str)``."""
    return rows.select(
        "cmp_id", "row_idx", F.posexplode("cells").alias("col_idx", "cell")
    ).select("cmp_id", "row_idx", "col_idx", "cell.*")


def choose_expected(cases: DataFrame, reference_rows: DataFrame, literal_rows: DataFrame) -> DataFrame:
    """Expected side per case: reference-query rows, literal rows, or a scalar value.

    ``cases(cmp_id, has_reference, reference_failed, has_rows, has_value, value)``. Rows of the
    other source are ignored; a failed reference compares with the empty result; a literal empty
    result is an expectation. Output ``(cmp_id, source, checked, reference_ok, row_idx, cells, value)``
    keeps cases without rows.
    """
    source = (
        F.when(F.col("has_reference"), "reference")
        .when(F.col("has_rows"), "rows")
        .when(F.col("has_value"), "value")
        .otherwise("none")
    )
    marked = cases.withColumn("source", source)
    rows = reference_rows.withColumn("_from", F.lit("reference")).unionByName(
        literal_rows.withColumn("_from", F.lit("rows"))
    )
    usable = ~(F.col("_from") == "reference") | ~F.coalesce(F.col("reference_failed"), F.lit(False))
    c, r = marked.alias("c"), rows.alias("r")
    return (
        c.join(
            r,
            (F.col("c.cmp_id") == F.col("r.cmp_id")) & (F.col("c.source") == F.col("r._from")) & usable,
            "left",
        )
        .select(
            "c.cmp_id",
            "c.source",
            (F.col("c.source") != "none").alias("checked"),
            (~(F.col("c.has_reference") & F.coalesce(F.col("c.reference_failed"), F.lit(False)))).alias(
                "reference_ok"
            ),
            "r.row_idx",
            "r.cells",
            F.when(F.col("c.source") == "value", F.col("c.value")).alias("value"),
        )
    )
