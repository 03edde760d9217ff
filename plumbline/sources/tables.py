"""Warehouse sources and the seed-to-mart staging of orders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENTITY_FIELDS = ("account", "database", "warehouse", "schema", "path", "url", "dbtable")
_SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
_FORMATS = ("parquet", "orc", "csv", "json", "jdbc", "table")
SEED_SCHEMA = "order_id string, order_date string, recognized_revenue string, customer_id string"


@dataclass(frozen=True)
class SourceSpec:
    """Where a relation lives.

    JDBC needs partitionColumn, lowerBound, upperBound and numPartitions, so that a table is not read by one task; a
    table known to be small is marked by the option ``small`` = ``true`` instead.
    """

    kind: str
    options: dict[str, str] = field(default_factory=dict)

    @property
    def identity(self) -> str:
        """Non-secret description for run records."""
        shown = [f"{k}={self.options[k]}" for k in _IDENTITY_FIELDS if self.options.get(k)]
        return ";".join([self.kind, *shown])


def source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.kind not in _FORMATS:
        raise ValueError(f"unsupported source kind '{spec.kind}'")
    if spec.kind == "table":
        return spark.read.table(spec.options["dbtable"])
    known = ("path", "account", "database", "warehouse", "schema")
    if spec.kind == "jdbc":
        missing = [o for o in _SPLIT if o not in spec.options]
        if missing and spec.options.get("small", "").lower() != "true":
            raise ValueError(f"a JDBC source needs {', '.join(missing)}, or small = true")
        return spark.read.format("jdbc").options(**{k: v for k, v in spec.options.items() if k != "small"}).load()
    options = {k: v for k, v in spec.options.items() if k not in known}
    return spark.read.format(spec.kind).options(**options).load(spec.options["path"])


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED_SCHEMA).option("header", True).csv(path)


def stage_orders(seed: DataFrame) -> DataFrame:
    """Typed orders as the mart shows them."""
    return seed.select(
        F.col("order_id").cast("int").alias("order_id"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("recognized_revenue").cast("decimal(18,2)").alias("recognized_revenue"),
        "customer_id",
    )
