"""Append-only run records and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_runs(runs: DataFrame, path: str, format: str = "parquet") -> None:
    """Append run records below ``agent=/dt=``.

    The rebalance hint lets AQE split the partition of a busy agent or day and join small ones.
    """
    (
        runs.withColumn("dt", F.to_date("created_at"))
        .hint("rebalance", "agent", "dt")
        .write.mode("append")
        .partitionBy("agent", "dt")
        .format(format)
        .save(path)
    )


def read_runs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Run records; filters on ``agent`` and ``dt`` prune folders."""
    return spark.read.format(format).load(path)


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results, one JSON record per line below ``agent=``."""
    results.hint("rebalance", "agent").write.mode("append").partitionBy("agent").json(path)
