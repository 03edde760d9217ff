"""Row numbers within groups that stay parallel when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut

HOT_ROWS = 4_000_000
_COPY_CHUNK = 65_536


def ranked(
    df: DataFrame,
    ids: Sequence[str],
    order: Sequence[str],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Zero-based position of every row within ``ids`` ordered by ``order``, then by all other columns.

    Groups up to ``hot_rows`` are numbered by a plain window. Larger ones are range-partitioned
    over many tasks and numbered by partition offsets, so no task ever sorts a whole hot group.
    """
    rest = [c for c in df.columns if c not in {*ids, *order}]
    total = [*order, *rest]
    plain = Window.partitionBy(*ids).orderBy(*total)
    sizes = df.groupBy(*ids).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    if sizes.isEmpty():
        return df.withColumn(name, F.row_number().over(plain).cast("bigint") - 1)
    hot_ids = cut(sizes.select(*ids))
    matches = [df[c].eqNullSafe(hot_ids[c]) for c in ids]
    cold = df.join(hot_ids, matches, "left_anti")
    hot = df.join(hot_ids, matches, "left_semi")
    return cold.withColumn(name, F.row_number().over(plain).cast("bigint") - 1).unionByName(
        _ranked_by_range(hot, ids, total, name).select(*df.columns, name)
    )


def _ranked_by_range(df: DataFrame, ids: Sequence[str], total: Sequence[str], name: str) -> DataFrame:
    keys = [*ids, *total]
    # identical rows become one row with a count, so copies cannot pile up in one range
    folded = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    placed = cut(
        folded.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_slot", 33))
    within = (
        Window.partitionBy(*ids, "_range").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*ids).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*ids, "_range")
        .agg(F.sum("_copies").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    left, right = placed.alias("p"), offsets.alias("o")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*ids, "_range"]]
    first = (
        left.join(right, same)
        .select("p.*", "o._offset")
        .withColumn("_first", F.col("_offset") + F.sum("_copies").over(within) - F.col("_copies"))
    )
    # copies are expanded in chunks that are shuffled apart before they are unrolled
    chunks = first.withColumn(
        "_chunk", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {_COPY_CHUNK})"))
    ).repartition("_first", "_chunk")
    return chunks.withColumn(
        name,
        F.explode(
            F.expr(
                f"sequence(_first + _chunk * {_COPY_CHUNK}, "
                f"_first + least((_chunk + 1) * {_COPY_CHUNK}, _copies) - 1)"
            )
        ),
    )
