"""Joins on overlapping intervals without comparing every row with every other.

An interval is ``[low, high)`` over numbers; one without length stands for a point. It belongs to the level of its length, the least power of
two that is not shorter, and so covers two buckets of its level at most, however long it is. Each row is told under its buckets of its own level and of
every coarser level of the other side: two rows meet in an equi-join at the coarser of their levels, are tested there, and count in the first bucket
that they share. Where all rows of one side are much shorter than those of the other, buckets have an eighth of that width, and the longer rows cover
nine at most: a point is tested against little more than the windows it lies in. Rows of a key of any weight are dealt out by their buckets, and a bucket
of very many pairs by its rows.

Rows without a bound, or with ``high`` below ``low``, overlap with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut

#: Intervals shorter than two to this power, points too, have this level.
FINEST = -10
#: Sides that are so many levels apart meet in buckets of that many levels below the coarser one.
FINER = 3
#: Pairs of rows that one task may look at under one key.
HOT_PAIRS = 100_000_000


def seconds(time: str | Column) -> Column:
    """Seconds since the epoch with fractions, as the joins take them."""
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp")) / 1e6


def _told(df: DataFrame, prefix: str, by: Sequence[str], low: str, high: str) -> DataFrame:
    start, end = F.col(low).cast("double"), F.col(high).cast("double")
    length = end - start
    level = F.greatest(F.lit(FINEST), F.ceil(F.log2(F.when(length > 0, length).otherwise(F.lit(2.0**FINEST))))).cast("int")
    return df.where((end >= start) & (F.abs(end) < float("inf")) & (F.abs(start) < float("inf"))).select(
        *[F.col(c).alias(f"_{c}") for c in by], start.alias(f"{prefix}_low"), end.alias(f"{prefix}_high"), level.alias(f"{prefix}_level"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{prefix}_row"))


def _bucket(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _in_parts(a: DataFrame, b: DataFrame, keys: Sequence[str], tasks: int, hot_pairs: int) -> DataFrame:
    """``a.join(b, keys)`` in ``tasks`` partitions; where a key has more than ``hot_pairs`` pairs its larger side is cut and the other repeated."""
    sizes = a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys)
    hot = sizes.where(F.col("n_a") * F.col("n_b") > hot_pairs).select(
        *keys, (F.col("n_a") >= F.col("n_b")).alias("_cut_a"),
        F.least(F.ceil(F.col("n_a").cast("double") * F.col("n_b") / hot_pairs), F.greatest("n_a", "n_b")).alias("_parts"))
    if not hot.isEmpty():
        hot = cut(hot)

        def parted(df: DataFrame, is_a: bool) -> DataFrame:
            p = "a" if is_a else "b"
            plain = [f"{p}_row.`{f.name}`" for f in df.schema[f"{p}_row"].dataType if isinstance(f.dataType, T.AtomicType)]
            part = F.pmod(F.xxhash64(f"{p}_low", f"{p}_high", *plain), "_parts")
            told = df.join(hot, list(keys), "left").withColumn("_part", F.explode(
                F.when(F.col("_parts").isNull(), F.array(F.lit(0).cast("long")))
                .when(F.col("_cut_a") == is_a, F.array(part)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))))
            return told.drop("_cut_a", "_parts")

        a, b, keys = parted(a, True), parted(b, False), [*keys, "_part"]
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), list(keys))


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str] = (), left_bounds: tuple[str, str] = ("low", "high"),
                 right_bounds: tuple[str, str] = ("low", "high"), hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``(left, right)`` structs of rows that are equal in ``by`` and whose intervals share a point. No column of a result is lost by a name.

    A point shares one with ``[low, high)`` if it lies in it; two points if they are equal. The result may be many times what is read, so the rows
    are dealt out over all shuffle partitions, and a bucket of more than ``hot_pairs`` pairs over several.
    """
    a, b = _told(left, "a", by, *left_bounds), _told(right, "b", by, *right_bounds)
    # levels that occur: as many as the exponents of a double at most, some dozens in practice
    found = a.select(F.lit("a").alias("side"), F.col("a_level").alias("level")).union(b.select(F.lit("b"), F.col("b_level"))).distinct().collect()
    of = {p: sorted(r.level for r in found if r.side == p) for p in "ab"}

    apart = max(of["a"], default=0) + FINER <= min(of["b"], default=0) or max(of["b"], default=0) + FINER <= min(of["a"], default=0)

    def dealt(df: DataFrame, p: str) -> DataFrame:
        own, others = F.col(f"{p}_level"), F.array(*[F.lit(x) for x in of["b" if p == "a" else "a"]]).cast("array<int>")
        meets = F.concat(F.when(F.exists(others, lambda x: x <= own), F.array(own)).otherwise(F.array().cast("array<int>")), F.filter(others, lambda x: x > own))
        at = df.withColumn("_level", F.explode(meets))
        width = F.col("_level") - (FINER if apart else 0)
        at = at.withColumns({f"{p}_first": _bucket(F.col(f"{p}_low"), width), "_last": _bucket(F.col(f"{p}_high"), width)})
        return at.withColumn("_bucket", F.explode(F.sequence(f"{p}_first", "_last"))).drop("_last")

    keys = [*[f"_{c}" for c in by], "_level", "_bucket"]
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = _in_parts(dealt(a, "a"), dealt(b, "b"), keys, tasks, hot_pairs)
    low, high = F.greatest("a_low", "b_low"), F.least("a_high", "b_high")
    reaches = lambda p: (F.col(f"{p}_high") > low) | (F.col(f"{p}_low") == F.col(f"{p}_high"))
    inside = (low < high) | ((low == high) & reaches("a") & reaches("b"))
    first = F.col("_bucket") == F.greatest("a_first", "b_first")
    return met.where((F.greatest("a_level", "b_level") == F.col("_level")) & first & inside).select(
        F.col("a_row").alias("left"), F.col("b_row").alias("right"))
