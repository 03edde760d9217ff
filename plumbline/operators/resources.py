"""Artifact documents to resource, column, test and lineage tables.

Inputs are ``manifests(manifest_digest, doc)``; every output carries ``manifest_digest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.variants import (
    flag_at,
    is_object,
    map_at,
    objects_at,
    overlay,
    squeeze,
    strings_at,
    text_at,
    unquote,
)


def _entries(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """Members of an object column as rows ``(*keep, key, value, pos)``; anything else gives none."""
    spark = df.sparkSession
    kept = ", ".join(f"d.{k}" for k in keep)
    return spark.sql(
        f"select {kept}, e.key, e.value, e.pos from {{d}} d, lateral variant_explode(d.{value}) e "
        "where e.key is not null",
        d=df,
    )


def resources_raw(manifests: DataFrame) -> DataFrame:
    """``(manifest_digest, unique_id, collection, raw)`` over all collections; a later collection wins."""
    collections = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.variant_get("doc", f"$.{name}", "variant").alias("members"))
            for i, name in enumerate(fixed.RESOURCE_COLLECTIONS)
        ]
    )
    parts = manifests.select("manifest_digest", F.explode(collections).alias("c")).select(
        "manifest_digest", F.col("c.ord").alias("ord"), F.col("c.members").alias("members")
    )
    return (
        _entries(parts, "members", "manifest_digest", "ord")
        .where(is_object(F.col("value")))
        .groupBy("manifest_digest", F.col("key").alias("unique_id"))
        .agg(F.max("ord").alias("ord"), F.max_by("value", "ord").alias("raw"))
        .withColumn("collection", F.get(F.array(*map(F.lit, fixed.RESOURCE_COLLECTIONS)), F.col("ord")))
        .drop("ord")
    )


def queryable(resource_type: Column, enabled: Column, materialized: Column) -> Column:
    return enabled & resource_type.isin(*fixed.QUERYABLE_TYPES) & ~materialized.eqNullSafe("ephemeral")


def normalize_resources(raw: DataFrame) -> DataFrame:
    """Resource fields with their fallbacks; tests are not resources."""
    r, uid = F.col("raw"), F.col("unique_id")
    empty = F.lit("")
    dotted = F.contains(uid, F.lit("."))
    constraints = objects_at(r, "$.constraints")
    fields = raw.where(~F.col("raw").isNull()).select(
        "manifest_digest",
        "unique_id",
        F.coalesce(text_at(r, "$.resource_type"), empty).alias("resource_type"),
        F.when(dotted, F.coalesce(text_at(r, "$.package_name"), F.split_part(uid, F.lit("."), F.lit(2))))
        .otherwise("")
        .alias("package"),
        F.coalesce(text_at(r, "$.name"), empty).alias("name"),
        F.coalesce(text_at(r, "$.alias", "$.identifier", "$.name"), empty).alias("alias"),
        unquote(text_at(r, "$.database")).alias("database"),
        unquote(text_at(r, "$.schema")).alias("schema"),
        F.coalesce(text_at(r, "$.relation_name"), empty).alias("relation_name"),
        F.coalesce(text_at(r, "$.original_file_path", "$.path"), empty).alias("path"),
        squeeze(text_at(r, "$.description")).alias("description"),
        F.array_sort(F.array_distinct(F.concat(strings_at(r, "$.tags"), strings_at(r, "$.config.tags")))).alias(
            "tags"
        ),
        text_at(r, "$.group", "$.config.group").alias("grp"),
        F.when(is_object(F.variant_get(r, "$.owner", "variant")), text_at(r, "$.owner.name", "$.owner.email"))
        .otherwise(text_at(r, "$.owner"))
        .alias("owner"),
        text_at(r, "$.access").alias("access"),
        text_at(r, "$.config.materialized").alias("materialized"),
        overlay(map_at(r, "$.config.meta"), map_at(r, "$.meta")).alias("meta"),
        F.when(F.size(constraints) > 0, constraints)
        .otherwise(objects_at(r, "$.config.constraints"))
        .alias("constraints"),
        F.when(is_object(F.variant_get(r, "$.checksum", "variant")), text_at(r, "$.checksum.checksum"))
        .otherwise(text_at(r, "$.checksum"))
        .alias("checksum"),
        flag_at(r, "$.config.enabled", missing=True).alias("enabled"),
    )
    return fields.where(F.col("resource_type") != "test").withColumn(
        "queryable", queryable(F.col("resource_type"), F.col("enabled"), F.col("materialized"))
    )


def groups(manifests: DataFrame) -> DataFrame:
    """Named groups with an owner: ``(manifest_digest, grp, group_owner)``."""
    found = _entries(
        manifests.select("manifest_digest", F.variant_get("doc", "$.groups", "variant").alias("members")),
        "members",
        "manifest_digest",
    )
    v = F.col("value")
    owner = F.when(
        is_object(F.variant_get(v, "$.owner", "variant")), text_at(v, "$.owner.name", "$.owner.email")
    ).otherwise(text_at(v, "$.owner"))
    named = found.select("manifest_digest", text_at(v, "$.name").alias("grp"), owner.alias("group_owner"), "pos")
    return (
        named.where(F.col("grp").isNotNull() & F.col("group_owner").isNotNull())
        .groupBy("manifest_digest", "grp")
        .agg(F.max_by("group_owner", "pos").alias("group_owner"))
    )


def with_owner(resources: DataFrame, groups: DataFrame) -> DataFrame:
    """Own owner, else that of the group."""
    return (
        resources.join(groups, ["manifest_digest", "grp"], "left")
        .withColumn("owner", F.coalesce("owner", "group_owner"))
        .drop("group_owner")
    )


def edges(manifests: DataFrame, raw: DataFrame) -> DataFrame:
    """Lineage ``(manifest_digest, parent_id, child_id, declared)``.

    Declared edges come from a resource's own dependencies and serve the walk to parents; the child
    map adds others that only the walk to children sees.
    """
    own = raw.select(
        "manifest_digest",
        F.explode(strings_at(F.col("raw"), "$.depends_on.nodes")).alias("parent_id"),
        F.col("unique_id").alias("child_id"),
        F.lit(True).alias("declared"),
    )
    listed = _entries(
        manifests.select("manifest_digest", F.variant_get("doc", "$.child_map", "variant").alias("members")),
        "members",
        "manifest_digest",
    ).select(
        "manifest_digest",
        F.col("key").alias("parent_id"),
        F.explode(F.try_variant_get("value", "$", "array<string>")).alias("child_id"),
        F.lit(False).alias("declared"),
    )
    return (
        own.unionByName(listed)
        .groupBy("manifest_digest", "parent_id", "child_id")
        .agg(F.bool_or("declared").alias("declared"))
    )


def columns(raw: DataFrame) -> DataFrame:
    """Declared columns; of two entries naming the same column the later one counts."""
    found = _entries(
        raw.select("manifest_digest", "unique_id", F.variant_get("raw", "$.columns", "variant").alias("members"),
                   text_at(F.col("raw"), "$.resource_type").alias("resource_type"))
        .where(~F.col("resource_type").eqNullSafe("test")),
        "members",
        "manifest_digest",
        "unique_id",
    ).where(is_object(F.col("value")))
    v = F.col("value")
    named = found.select(
        "manifest_digest",
        "unique_id",
        "pos",
        F.coalesce(text_at(v, "$.name"), F.col("key")).alias("column_name"),
        "value",
    )
    last = named.groupBy("manifest_digest", "unique_id", "column_name").agg(
        F.min("pos").alias("ordinal"), F.max_by("value", "pos").alias("value")
    )
    return last.select(
        "manifest_digest",
        "unique_id",
        "ordinal",
        "column_name",
        squeeze(text_at(v, "$.description")).alias("description"),
        F.try_variant_get(v, "$.data_type", "string").alias("data_type"),
        objects_at(v, "$.constraints").alias("constraints"),
        map_at(v, "$.meta").alias("meta"),
        strings_at(v, "$.tags").alias("tags"),
    )


def tests(raw: DataFrame, resources: DataFrame) -> DataFrame:
    """Tests, once per known resource they depend on: ``(manifest_digest, test_id, target_id, name, column_name, arguments)``."""
    r = F.col("raw")
    found = raw.where(
        (F.col("collection") == "nodes") & text_at(r, "$.resource_type").eqNullSafe("test")
    ).select(
        "manifest_digest",
        F.col("unique_id").alias("test_id"),
        F.explode(strings_at(r, "$.depends_on.nodes")).alias("target_id"),
        F.coalesce(text_at(r, "$.test_metadata.name", "$.name"), "unique_id").alias("name"),
        F.coalesce(
            F.try_variant_get(r, "$.test_metadata.kwargs.column_name", "string"),
            F.try_variant_get(r, "$.column_name", "string"),
        ).alias("column_name"),
        F.variant_get(r, "$.test_metadata.kwargs", "variant").alias("arguments"),
    )
    known = resources.select("manifest_digest", F.col("unique_id").alias("target_id"))
    return found.join(known, ["manifest_digest", "target_id"], "left_semi").select(*found.columns)


def _catalog_entries(catalogs: DataFrame) -> DataFrame:
    """Members of ``nodes`` and ``sources`` of catalog documents ``(manifest_digest, doc)``; of two like ids the latter counts."""
    both = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.variant_get("doc", f"$.{n}", "variant").alias("members"))
            for i, n in enumerate(("nodes", "sources"))
        ]
    )
    parts = catalogs.select("manifest_digest", F.explode(both).alias("c")).select(
        "manifest_digest", F.col("c.ord").alias("ord"), F.col("c.members").alias("members")
    )
    entries = _entries(parts, "members", "manifest_digest", "ord").where(is_object(F.col("value")))
    return entries.groupBy("manifest_digest", F.col("key").alias("unique_id")).agg(F.max_by("value", "ord").alias("value"))


def catalog_statistics(catalogs: DataFrame, resources: DataFrame) -> DataFrame:
    """Statistics of whole resources ``(manifest_digest, unique_id, statistics)`` for the known ones that a catalog describes."""
    found = _catalog_entries(catalogs).select("manifest_digest", "unique_id", map_at(F.col("value"), "$.stats").alias("statistics"))
    return found.join(resources.select("manifest_digest", "unique_id"), ["manifest_digest", "unique_id"], "left_semi")


def catalog_columns(catalogs: DataFrame) -> DataFrame:
    """Physical columns of catalog documents ``(manifest_digest, doc)``."""
    resources = _catalog_entries(catalogs).select("manifest_digest", "unique_id", F.variant_get("value", "$.columns", "variant").alias("members"))
    found = _entries(resources, "members", "manifest_digest", "unique_id").where(is_object(F.col("value")))
    v = F.col("value")
    return found.select(
        "manifest_digest",
        "unique_id",
        "pos",
        F.coalesce(text_at(v, "$.name"), F.col("key")).alias("physical_name"),
        text_at(v, "$.type").alias("physical_type"),
        map_at(v, "$.stats").alias("statistics"),
    )


def enrich_catalog(columns: DataFrame, physical: DataFrame, resources: DataFrame) -> DataFrame:
    """Add physical types and statistics by case-insensitive name, and columns nobody declared.

    A declared type stays; physical columns of unknown resources are ignored.
    """
    known = physical.join(
        resources.select("manifest_digest", "unique_id"), ["manifest_digest", "unique_id"], "left_semi"
    )
    latest = known.groupBy("manifest_digest", "unique_id", F.lower("physical_name").alias("folded")).agg(
        F.min("pos").alias("pos"),
        F.max_by("physical_name", "pos").alias("physical_name"),
        F.max_by("physical_type", "pos").alias("physical_type"),
        F.max_by("statistics", "pos").alias("statistics"),
    )
    declared = columns.withColumn("folded", F.lower("column_name"))
    of_resource = Window.partitionBy("manifest_digest", "unique_id")  # undeclared columns follow the last declared one
    return (
        declared.join(latest, ["manifest_digest", "unique_id", "folded"], "full_outer")
        .withColumn("data_type", F.coalesce(F.nullif("data_type", F.lit("")), "physical_type"))
        .withColumn("ordinal", F.coalesce("ordinal", F.col("pos") + 1 + F.coalesce(F.max("ordinal").over(of_resource), F.lit(-1))))
        .withColumn("column_name", F.coalesce("column_name", "physical_name"))
        .withColumn("description", F.coalesce("description", F.lit("")))
        .drop("folded", "physical_name", "pos")
    )


def test_statuses(run_results: DataFrame) -> DataFrame:
    """Latest status per test: ``(manifest_digest, test_id, status)``; the last record wins."""
    found = run_results.select(
        "manifest_digest",
        F.posexplode(F.try_variant_get("doc", "$.results", "array<variant>")).alias("pos", "item"),
    )
    item = F.col("item")
    known = found.select(
        "manifest_digest",
        text_at(item, "$.unique_id").alias("test_id"),
        text_at(item, "$.status").alias("status"),
        "pos",
    ).where(F.col("test_id").isNotNull() & F.col("status").isNotNull())
    return latest_status(known)


def latest_status(records: DataFrame) -> DataFrame:
    return records.groupBy("manifest_digest", "test_id").agg(F.max_by("status", "pos").alias("status"))


def enrich_status(tests: DataFrame, statuses: DataFrame) -> DataFrame:
    return tests.join(statuses, ["manifest_digest", "test_id"], "left")


def summary(resources: DataFrame) -> DataFrame:
    """Distinct facets of the queryable resources: ``(manifest_digest, facet, value, n_resources)``.

    The facet 'model_count' has one row per manifest; groups, tags, packages and parent paths have
    one row per value.
    """
    path = F.col("path")
    parent = F.when(
        F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")
    ).otherwise(".")

    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    single = F.array(
        facet("model_count", F.when(F.col("resource_type") == "model", "")),
        facet("group", F.nullif("grp", F.lit(""))),
        facet("package", F.nullif("package", F.lit(""))),
        facet("path", F.when(path != "", parent)),
    )
    tagged = F.transform("tags", lambda t: facet("tag", t))
    return (
        resources.where("queryable")
        .select("manifest_digest", F.explode(F.concat(single, tagged)).alias("f"))
        .where(F.col("f.value").isNotNull())
        .groupBy("manifest_digest", "f.facet", "f.value")
        .agg(F.count("*").alias("n_resources"))
    )
