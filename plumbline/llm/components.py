"""Connected components of a link table, by alternating star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import written

MOST_ROUNDS = 60


def _shrink(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node hands its neighbours (the larger ones, or else itself and the smaller ones) to its least neighbour."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), "m")
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("x"), "m").unionAll(least.select(F.col("u").alias("x"), "m"))
    return moved.where("x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``: the component is its smallest node. Self-links and nulls are ignored.

    Every round is written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        edges = written(_shrink(_shrink(edges, True), False), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
