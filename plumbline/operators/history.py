"""Catalog history: which snapshot of the catalog was in force when a run took place.

A catalog changes: resources are renamed, removed, declared sensitive. Every table about resources is keyed by ``manifest_digest``, the
snapshot it describes, and a run has to be judged by the snapshot that its agent knew at the time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, since: str, values: Sequence[str], slot_seconds: int = 86_400) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` that is not later: equal in ``by``, ``since <= at``.

    Rows without an earlier one, or without a time, get nulls. Of rows of ``right`` at one instant the one with the greatest values counts.
    The times are cut into slots. What holds at the start of a slot is found among the slots that occur and the rows of ``right``, which
    are few; within a slot both sides are sorted together. So a key that holds most of ``left`` is dealt out by its slots.
    """
    def slot(time: str):
        return F.floor(F.col(time).cast("timestamp").cast("double") / slot_seconds)

    inside = left.columns
    timed = left.where(F.col(at).isNotNull())
    rows = timed.withColumn("_slot", slot(at)).withColumn("_left", F.struct(*[F.col(f"`{c}`") for c in inside]))
    told = right.select(*by, slot(since).alias("_slot"), F.col(since).cast("timestamp").alias("_at"), F.struct(*values).alias("_value")).where("_at is not null")
    told = told.groupBy(*by, "_slot", "_at").agg(F.max("_value").alias("_value"))
    # the value carried into each slot
    empty = told.schema["_value"].dataType
    slots = rows.select(*by, "_slot").distinct().withColumn("_value", F.lit(None).cast(empty)).withColumn("_new", F.lit(0))
    last = told.groupBy(*by, "_slot").agg(F.max_by("_value", "_at").alias("_value")).withColumn("_new", F.lit(1))
    before = Window.partitionBy(*by).orderBy("_slot", "_new").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = slots.unionByName(last).withColumn("_value", F.last("_value", ignorenulls=True).over(before)).where("_new = 0 and _value is not null")
    none = F.lit(None)
    moves = told.join(slots.select(*by, "_slot"), [*by, "_slot"], "left_semi")
    both = (
        carried.select(*by, "_slot", none.cast("timestamp").alias("_at"), "_value", F.lit(0).alias("_order"))
        .unionByName(moves.select(*by, "_slot", "_at", "_value", F.lit(1).alias("_order")))
        .withColumn("_left", none.cast(rows.schema["_left"].dataType))
        .unionByName(rows.select(*by, "_slot", F.col(at).cast("timestamp").alias("_at"), none.cast(empty).alias("_value"), F.lit(2).alias("_order"), "_left"))
    )
    within = Window.partitionBy(*by, "_slot").orderBy(F.col("_at").asc_nulls_first(), "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(within)).where("_order = 2")
    found = found.select(*[F.col("_left").getField(c).alias(c) for c in inside], *[F.col("_value").getField(v).alias(v) for v in values])
    kinds = {f.name: f.dataType for f in found.schema}
    return found.unionByName(left.where(F.col(at).isNull()).select("*", *[none.cast(kinds[v]).alias(v) for v in values]))


def in_force(log: DataFrame, snapshots: DataFrame, at: str = "ran_at") -> DataFrame:
    """The log with the ``manifest_digest`` in force for the row's agent; ``snapshots(agent, manifest_digest, since)``."""
    return as_of(log, snapshots, ["agent"], at, "since", ["manifest_digest"])
