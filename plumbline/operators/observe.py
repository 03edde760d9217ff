"""Trace records, usage, test health and checks on payloads and tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.json_schema import violation
from plumbline.functions.variants import is_object, strict_json

TRACE_SCHEMA = """
question string,
interpretation struct<intent: string, metrics: array<string>, dimensions: array<string>,
                      start_date: string, end_date: string, assumptions: array<string>>,
dbt_context struct<manifest_digest: string, catalog_digest: string, selected_nodes: array<string>,
                   columns: array<string>, relevant_tests: array<string>, test_health: map<string, string>>,
sql struct<generated: string, executed: string, dialect: string>,
result struct<rows: array<map<string, string>>, row_count: bigint>,
answer struct<text: string, claims: array<struct<text: string, evidence: array<struct<row: bigint, column: string>>>>>,
verification array<struct<name: string, passed: boolean, message: string>>,
agent string, agent_digest string, model_identity string, warehouse_identity string,
usage struct<latency_ms: double, prompt_tokens: bigint, completion_tokens: bigint, estimated_cost: double>,
eval_suite_digest string, created_at string
"""


def json_safe(value: Column, dtype: T.DataType) -> Column:
    """Decimals, dates and timestamps as text, at any depth."""
    if isinstance(dtype, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def trace_json(traces: DataFrame, key: str) -> DataFrame:
    """``(key, record)``: everything but the key as one JSON object with sorted names, nulls kept."""
    fields = sorted((f for f in traces.schema.fields if f.name != key), key=lambda f: f.name)
    record = F.struct(*[json_safe(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return traces.select(key, F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def parse_traces(records: DataFrame, column: str = "record") -> DataFrame:
    """Records back to columns by the fixed schema."""
    parsed = records.withColumn("_t", F.from_json(column, TRACE_SCHEMA))
    return parsed.select(*[c for c in records.columns if c != column], "_t.*")


def usage_report(traces: DataFrame, *keys: str) -> DataFrame:
    """Runs, latency and tokens per group."""
    latency = F.col("latency_ms")
    measures = [
        F.count("*").alias("n_runs"),
        F.avg(latency).alias("avg_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    ]
    return traces.groupBy(*keys).agg(*measures)


def latency_sketches(traces: DataFrame, *keys: str, k: int = 400) -> DataFrame:
    """One mergeable quantile sketch of the latencies per group, to be stored: ``(*keys, n_runs, sketch)``.

    A sketch has a few kilobytes, whatever the number of runs. The rank of what it tells is off by about 2.3 / k ** 0.9 of the runs at most,
    with 99 percent confidence (1.1 percent for ``k = 400``). Runs without a latency do not count.
    """
    known = traces.where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"))
    return known.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, *keys: str, at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of coarser groups from stored sketches, which are merged; no run is read again: ``(*keys, n_runs, p50_latency_ms, ...)``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n_runs").alias("n_runs"), F.kll_merge_agg_double("sketch").alias("sketch"))
    told = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(p * 100)}_latency_ms") for p in at]
    return merged.select(*keys, "n_runs", *told)


def test_health(usage: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests, in the trace's snapshot, of the resources a trace used: ``(trace_id, name, status)``; the status where known."""
    resource = ["manifest_digest", "unique_id"]
    by_resource = tests.withColumnRenamed("target_id", "unique_id").select(*resource, "name", "status").distinct()
    used = usage.select("trace_id", *resource).distinct()
    return used.join(by_resource, resource).select("trace_id", "name", "status").distinct()


def validate_json(df: DataFrame, column: str, schema: dict[str, Any]) -> DataFrame:
    """Adds ``problem``: why a text is no JSON value of the schema.

    A number written with a fraction is no integer, not even ``1.0``; the parser would drop the zero, so such numbers get an exponent first.
    """
    told = F.regexp_replace(column, r"(?<![\w.+\-\"])(-?\d+\.\d+)(?![\w.+\-])", "$1e0")
    return (
        df.withColumn("_doc", strict_json(F.col(column)))
        .withColumn("_told", F.when(F.col("_doc").isNotNull(), F.coalesce(strict_json(told), F.col("_doc"))))
        .withColumn(
            "problem",
            F.when(F.col("_doc").isNull(), "malformed JSON").otherwise(violation(F.col("_told"), schema)),
        )
        .drop("_doc", "_told")
    )


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """Adds ``doc`` and ``problem``: the object in a model response.

    A fence around the whole text is taken off. A text that then does not parse is searched for its
    first complete object, in Python and only for such rows.
    """
    text = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    fenced = text.rlike(r"(?is)^```(json)?\n.*```$")
    body = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(json)?\n", ""), r"```$", "")
    candidate = F.when(fenced, F.regexp_replace(body, r"(?U)^\s+|\s+$", "")).otherwise(text)
    direct = df.withColumn("_text", candidate).withColumn("_direct", strict_json(F.col("_text")))
    salvaged = _first_object(F.when(F.col("_direct").isNull(), F.col("_text")))
    found = direct.withColumn("_doc", F.coalesce("_direct", F.try_parse_json(salvaged)))
    return found.withColumns(
        {
            "doc": F.when(is_object(F.col("_doc")), F.col("_doc")),
            "problem": F.when(F.col("_doc").isNull(), "malformed JSON").when(
                ~is_object(F.col("_doc")), "Model structured output must be an object"
            ),
        }
    ).drop("_text", "_direct", "_doc")


@F.pandas_udf(T.StringType())
def _first_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    decoder = json.JSONDecoder()

    def salvage(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text))
        except ValueError:
            pass
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                if isinstance(value, dict):
                    return json.dumps(value)
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    for batch in texts:
        yield batch.map(salvage, na_action=None).astype(object)


def metric_usage(traces: DataFrame, *keys: str) -> DataFrame:
    """How often each metric is named in interpretations."""
    return (
        traces.select(*keys, F.explode("interpretation.metrics").alias("metric"))
        .groupBy(*keys, "metric")
        .agg(F.count("*").alias("n_runs"))
    )


def interpretations(traces: DataFrame, *keys: str) -> DataFrame:
    """Interpretation fields as columns."""
    return traces.select(*keys, "interpretation.*")


def run_data_tests(
    df: DataFrame,
    name: str,
    not_null: Sequence[str] = (),
    unique: Sequence[str] = (),
    primary_key: Sequence[str] = (),
) -> DataFrame:
    """Declared tests on a table: ``(table_name, test, column_name, failures, status)``.

    All null checks share one pass; uniqueness counts values held more than once.
    """
    spark_parts = []
    nulls = sorted({*not_null, *primary_key}, key=[*not_null, *primary_key].index)
    if nulls:
        counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nulls])
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in nulls])
        spark_parts.append(
            counted.select(F.explode(pairs).alias("p")).select(
                F.lit("not_null").alias("test"), F.col("p.c").alias("column_name"), F.col("p.n").alias("failures")
            )
        )
    groups = [("unique", [c]) for c in unique] + ([("primary_key", list(primary_key))] if primary_key else [])
    for test, columns in groups:
        present = df
        for c in columns:
            present = present.where(F.col(c).isNotNull())
        repeated = present.groupBy(*columns).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        spark_parts.append(
            repeated.agg(F.count("*").alias("failures")).select(
                F.lit(test).alias("test"), F.lit(", ".join(columns)).alias("column_name"), "failures"
            )
        )
    out = spark_parts[0]
    for part in spark_parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.lit(name).alias("table_name"),
        "test",
        "column_name",
        "failures",
        F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"),
    )
