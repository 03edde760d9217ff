"""Artifact documents: reading, checking and fingerprinting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.variants import is_object, strict_json


def digest(doc: Column) -> Column:
    """SHA-256 of the canonical form: keys sorted, no blanks."""
    return F.sha2(F.to_json(doc), 256)


def parse_documents(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, doc, digest, problem)``; a text that is no JSON object has a problem and no document.

    The document is exploded from an array of one, since what is generated is made once: a column would be parsed anew in every filter and
    field that goes by it.
    """
    doc = strict_json(F.col(text))
    parsed = texts.select(F.col(key).alias("key"), F.explode(F.array(doc)).alias("doc"))
    good = is_object(F.col("doc"))
    return parsed.select(
        "key",
        F.when(good, F.col("doc")).alias("doc"),
        F.when(good, digest(F.col("doc"))).alias("digest"),
        F.when(F.col("doc").isNull(), "invalid JSON").when(~good, "expected an object").alias("problem"),
    )


def read_artifacts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file; each document is read whole, files in parallel."""
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    texts = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_documents(texts, "path")


def manifests(documents: DataFrame) -> DataFrame:
    """``(manifest_digest, manifest_version, dbt_version, doc)`` of the readable documents."""
    version = lambda p: F.coalesce(F.try_variant_get("doc", p, "string"), F.lit(""))
    return documents.where(F.col("problem").isNull()).select(
        F.col("digest").alias("manifest_digest"),
        version("$.metadata.dbt_schema_version").alias("manifest_version"),
        version("$.metadata.dbt_version").alias("dbt_version"),
        "doc",
    )
