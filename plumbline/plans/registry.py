"""Registration of queries with their SQL twins, and table access."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SOURCE = re.compile(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b", re.IGNORECASE)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is plain SQL over the base tables giving the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a fixture's SQL on Spark with its base tables read straight from their files."""
    root = sf_dir.rstrip("/")
    return spark.sql(_SOURCE.sub(lambda m: f"{m[1]} parquet.`{root}/{m[2].lower()}.parquet`", sql))
