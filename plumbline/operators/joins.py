"""Equi-joins on keys that sort badly, and distinct rows of tables that hardly repeat any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_key_hash"


def hashed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)``, led by a hash of the keys.

    A sort compares the first eight bytes of its first key before all else. An agent or a digest has few values, and ids and names of one kind
    begin alike, so that sorting by them compares whole rows; the hash tells them apart at once. The keys themselves still decide.
    """
    value = F.hash(*keys)  # four bytes that no shuffle can pack
    return left.withColumn(_HASH, value).join(right.withColumn(_HASH, value), [_HASH, *keys], how).drop(_HASH)


def dealt_distinct(df: DataFrame) -> DataFrame:
    """``df.distinct()`` for rows that are hardly ever alike: they are dealt out before anything is held.

    Otherwise each task over the files gathers all its rows first, as many as a file or a split of one has, and drops none.
    """
    return df.repartition(*df.columns).distinct()
