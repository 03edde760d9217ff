"""Access audit of a query log, from facts about the queries.

Facts, all keyed by ``query_id``:
``statements(ord, depth, kind)``, ``functions(ord, name)``,
``relations(ord, agent, manifest_digest, ref, alias, is_cte)``, ``joins(ord, has_on, has_using)``,
``columns(ord, qualifier, name)``, ``derived(alias, column_name)`` for CTEs and derived tables, and
``select_aliases(name)``.

Each check yields failures ``(query_id, ordinal, pos, check, message)``, one row per finding: ``ordinal`` is the place of the check, ``pos``
where in the query it was met. ``audit`` keeps the first per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import fold
from plumbline.operators.joins import hashed_join
from plumbline.session import stored

CHECKS = (
    "read_only",
    "forbidden_functions",
    "resources_in_scope",
    "relations_unambiguous",
    "join_conditions",
    "columns_exist",
    "sensitive_access",
)


def _failures(df: DataFrame, check: str, message: Column, pos: Column | int = 0) -> DataFrame:
    return df.select(
        "query_id",
        F.lit(CHECKS.index(check)).alias("ordinal"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("long").alias("pos"),
        F.lit(check).alias("check"),
        message.alias("message"),
    )


def audit_read_only(statements: DataFrame) -> DataFrame:
    """Exactly one statement, a query, with no write or command anywhere inside."""
    top, kind = F.col("depth") == 0, F.lower("kind")
    per_query = statements.groupBy("query_id").agg(
        F.count_if(top).alias("n"),
        F.bool_and(F.when(top, kind.isin(*fixed.QUERY_KINDS))).alias("is_query"),
        F.bool_or(kind.isin(*fixed.WRITE_KINDS)).alias("writes"),
    )
    message = (
        F.when(F.col("n") != 1, "Exactly one SQL query statement is required")
        .when(~F.col("is_query"), "Only a read-only query statement is allowed")
        .when(F.col("writes"), "SQL contains a forbidden write or command operation")
    )
    failed = per_query.withColumn("message", message).where(F.col("message").isNotNull())
    return _failures(failed, "read_only", F.col("message"))


def audit_functions(functions: DataFrame) -> DataFrame:
    bad = functions.where(F.lower("name").isin(*fixed.FORBIDDEN_FUNCTIONS)).groupBy("query_id", "name").agg(F.min("ord").alias("ord"))
    return _failures(
        bad, "forbidden_functions", F.concat(F.lit("Function '"), "name", F.lit("' is forbidden")), F.col("ord")
    )


def base_relations(relations: DataFrame) -> DataFrame:
    """References that are not to a CTE; only an unqualified name can be one."""
    qualified = F.contains("ref", F.lit("."))
    return relations.where(~F.col("is_cte") | qualified)


def audit_scope(queries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every relation lies in the scope and is unambiguous, and there is at least one.

    ``resolved`` are base relations with ``status`` from ``resolve_relations``.
    """
    bad = resolved.where(F.col("status") != "resolved").groupBy("query_id", "ref", "status").agg(F.min("ord").alias("ord"))
    ambiguous = F.col("status") == "ambiguous"
    found = bad.select(
        "query_id",
        F.lit(CHECKS.index("resources_in_scope")).alias("ordinal"),
        F.col("ord").cast("long").alias("pos"),
        F.when(ambiguous, "relations_unambiguous").otherwise("resources_in_scope").alias("check"),
        F.concat(
            F.lit("Relation '"),
            "ref",
            F.when(ambiguous, "' is ambiguous").otherwise(
                "' is not a manifest-backed resource in agent scope"
            ),
        ).alias("message"),
    )
    idle = queries.select("query_id").join(resolved.select("query_id"), "query_id", "left_anti")
    return found.unionByName(
        _failures(
            idle,
            "resources_in_scope",
            F.lit("SQL must query at least one manifest-backed relation"),
        )
    )


def query_usage(resolved: DataFrame) -> DataFrame:
    """Used resources per query and alias: ``(query_id, alias, manifest_digest, unique_id)``; the last of two like aliases counts."""
    used = resolved.where(F.col("status") == "resolved")
    return used.groupBy("query_id", F.lower("alias").alias("alias")).agg(
        F.max("manifest_digest").alias("manifest_digest"), F.max_by("unique_id", "ord").alias("unique_id")
    )


def used_resources(resolved: DataFrame) -> DataFrame:
    """``(query_id, manifest_digest, unique_id, ord)``: each resource once, with the place where the query first names it."""
    return resolved.where(F.col("status") == "resolved").groupBy("query_id", "manifest_digest", "unique_id").agg(F.min("ord").alias("ord"))


def audit_joins(used: DataFrame, joins: DataFrame) -> DataFrame:
    """More than one resource needs a join, and every join a condition."""
    several = (
        used.groupBy("query_id")
        .agg(F.min("unique_id").alias("low"), F.max("unique_id").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("query_id")
    )
    conditioned = joins.groupBy("query_id").agg(
        F.bool_and(F.col("has_on") | F.col("has_using")).alias("conditioned")
    )
    bad = several.join(conditioned, "query_id", "left").where(
        ~F.coalesce("conditioned", F.lit(False))
    )
    return _failures(
        bad, "join_conditions", F.lit("Every multi-relation query requires explicit join conditions")
    )


def resolve_columns(
    columns: DataFrame,
    usage: DataFrame,
    used: DataFrame,
    derived: DataFrame,
    select_aliases: DataFrame,
    resource_columns: DataFrame,
) -> DataFrame:
    """Column references with ``status``: derived, derived_missing, alias, found, ambiguous or missing.

    A qualified name is looked up on the resource behind its alias; an unqualified one, or one with an
    unknown qualifier, among the columns of all used resources. Those are counted per query and name
    beforehand, so that a reference meets one row at most.
    """
    refs = columns.where(F.col("name") != "*").select(
        "query_id",
        "ord",
        F.coalesce("qualifier", F.lit("")).alias("qualifier"),
        "name",
        F.lower(F.coalesce("qualifier", F.lit(""))).alias("alias"),
        F.lower("name").alias("folded"),
    )
    derived_columns = stored(
        derived.select("query_id", F.lower("alias").alias("alias"), F.lower("column_name").alias("folded")).distinct(), "derived-columns")
    resource = ["manifest_digest", "unique_id"]
    # as many as a table has
    known = resource_columns.groupBy(*resource).agg(F.collect_set(F.lower("column_name")).alias("known"))
    # what an alias of a query stands for, in one row
    behind = usage.groupBy("query_id", "alias").agg(*[F.max(c).alias(c) for c in resource])
    derived_aliases = derived_columns.select("query_id", "alias").distinct().withColumn("is_derived", F.lit(True))
    qualified = F.col("qualifier") != ""
    placed = stored(
        refs.where(qualified)
        .join(behind, ["query_id", "alias"], "left")
        .join(derived_aliases, ["query_id", "alias"], "left")
        .unionByName(refs.where(~qualified), allowMissingColumns=True)
        .withColumn("is_derived", F.coalesce("is_derived", F.lit(False))),
        "placed-columns",
    )
    # each reference goes the one way that can settle it, so none waits for a key it does not have
    shown = ["query_id", "ord", "qualifier", "name"]
    hit = F.coalesce("hit", F.lit(False))
    of_derived = (
        placed.where("is_derived")
        .join(derived_columns.withColumn("hit", F.lit(True)), ["query_id", "alias", "folded"], "left")
        .select(*shown, F.when(hit, "derived").otherwise("derived_missing").alias("status"))
    )
    has = F.coalesce(F.array_contains("known", F.col("folded")), F.lit(False))
    of_resource = (
        hashed_join(placed.where(~F.col("is_derived") & F.col("unique_id").isNotNull()).select(*shown, "folded", *resource), known, resource, "left")
        .select(*shown, F.when(has, "found").otherwise("missing").alias("status"))
    )
    loose = placed.where(~F.col("is_derived") & F.col("unique_id").isNull()).select(*shown, "folded")
    # the names that a query looks up anywhere go along with each of its resources, in one row
    asked = loose.groupBy("query_id").agg(F.collect_set("folded").alias("names"))
    candidates = stored(used.drop("ord").join(asked, "query_id"), "asked-resources")
    anywhere = stored(
        hashed_join(candidates, known, resource)
        .select("query_id", F.explode(F.array_intersect("names", "known")).alias("folded"))
        .groupBy("query_id", "folded")
        .agg(F.count("*").alias("n_anywhere")),
        "names-anywhere",
    )
    met = loose.join(anywhere, ["query_id", "folded"], "left").withColumn("n", F.coalesce("n_anywhere", F.lit(0)))
    from_anywhere = met.where(qualified).select(*shown, F.when(F.col("n") == 0, "missing").otherwise("found").alias("status"))
    bare = (
        met.where(~qualified)
        .join(select_aliases.select("query_id", "name", F.lit(True).alias("hit")).distinct(), ["query_id", "name"], "left")
        .select(
            *shown,
            F.when((F.col("n") == 0) & hit, "alias")
            .when(F.col("n") == 0, "missing")
            .when(F.col("n") > 1, "ambiguous")
            .otherwise("found")
            .alias("status"),
        )
    )
    return of_derived.unionByName(of_resource).unionByName(from_anywhere).unionByName(bare)


def audit_columns(resolved_columns: DataFrame) -> DataFrame:
    shown = F.concat(F.when(F.col("qualifier") != "", F.concat("qualifier", F.lit("."))).otherwise(""), "name")
    message = (
        F.when(
            F.col("status") == "derived_missing",
            F.concat(
                F.lit("Column '"), shown, F.lit("' does not exist in derived relation '"), "qualifier", F.lit("'")
            ),
        )
        .when(
            F.col("status") == "missing",
            F.concat(F.lit("Column '"), shown, F.lit("' does not exist on a selected dbt resource")),
        )
        .when(
            F.col("status") == "ambiguous",
            F.concat(
                F.lit("Unqualified column '"),
                "name",
                F.lit("' is ambiguous across selected dbt resources"),
            ),
        )
    )
    bad = resolved_columns.withColumn("message", message).where(F.col("message").isNotNull())
    return _failures(bad.groupBy("query_id", "message").agg(F.min("ord").alias("ord")), "columns_exist", F.col("message"), F.col("ord"))


def used_columns(resolved_columns: DataFrame) -> DataFrame:
    """Distinct physical columns per query, as named in the query."""
    return resolved_columns.where(F.col("status").isin("found", "ambiguous")).select("query_id", "name").distinct()


def audit_sensitive_models(
    used: DataFrame, queries: DataFrame, resources: DataFrame, allow: DataFrame
) -> DataFrame:
    """Sensitive resources need their id in the agent's ``allow(agent, item)``. Resources count in the order of their first use."""
    resource = ["manifest_digest", "unique_id"]
    flagged = resources.where(_is_true("meta", "sensitive")).select(*resource)
    hit = hashed_join(used, flagged, resource).join(queries.select("query_id", "agent"), "query_id")
    bad = hit.join(allow.select("agent", F.col("item").alias("unique_id")), ["agent", "unique_id"], "left_anti")
    return _failures(
        bad,
        "sensitive_access",
        F.concat(F.lit("Sensitive model '"), "unique_id", F.lit("' requires explicit permission")),
        2 * F.col("ord"),
    )


def _is_true(meta: str, key: str) -> Column:
    return F.coalesce(
        F.try_variant_get(F.try_element_at(meta, F.lit(key)), "$", "boolean")
        & (F.schema_of_variant(F.try_element_at(meta, F.lit(key))) == "BOOLEAN"),
        F.lit(False),
    )


def sensitive_columns(resources: DataFrame, columns: DataFrame) -> DataFrame:
    """``(manifest_digest, unique_id, column_name)``: listed by the resource or flagged on the column."""
    listed = resources.select(
        "manifest_digest",
        "unique_id",
        F.explode(
            F.try_variant_get(F.try_element_at("meta", F.lit("sensitive_columns")), "$", "array<string>")
        ).alias("column_name"),
    )
    flagged = columns.where(_is_true("meta", "sensitive")).select("manifest_digest", "unique_id", "column_name")
    return listed.unionByName(flagged).distinct()


def audit_sensitive_columns(
    used: DataFrame, names: DataFrame, queries: DataFrame, sensitive: DataFrame, allow: DataFrame
) -> DataFrame:
    """Used names that are sensitive on a used resource and not allowed to the agent, ignoring case: one failure per resource names them all."""
    s = sensitive.select("manifest_digest", "unique_id", F.lower("column_name").alias("folded")).distinct()
    watched = hashed_join(used, s, ["manifest_digest", "unique_id"]).select("query_id", "unique_id", "ord", "folded")
    hit = (
        names.select("query_id", "name", F.lower("name").alias("folded"))
        .join(watched, ["query_id", "folded"])
        .join(queries.select("query_id", "agent"), "query_id")
    )
    permitted = allow.select("agent", F.lower("item").alias("folded")).distinct()
    bad = hit.join(permitted, ["agent", "folded"], "left_anti").groupBy("query_id", "unique_id", "ord").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("denied"))  # as many as the query names
    return _failures(
        bad,
        "sensitive_access",
        F.concat(F.lit("Sensitive columns require explicit permission: "), "denied"),
        2 * F.col("ord") + 1,
    )


def cap_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows; a smaller limit inside ``df`` still holds."""
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    return df.limit(max_rows)


def audit(queries: DataFrame, *failures: DataFrame) -> DataFrame:
    """Verdict per query ``(query_id, passed, failed_check, message)``: the first failed check decides, and within it the first place.

    Each check is written, with its first failure per query, before the next one is run.
    """
    def firsts(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id").agg(
            F.min_by(F.struct("ordinal", "pos", "check", "message"), F.struct("ordinal", "pos", "message")).alias("f")
        )

    found = stored(firsts(failures[0]), "failures")
    for part in failures[1:]:
        found = found.unionByName(stored(firsts(part), "failures"))
    first = firsts(found.select("query_id", "f.*"))
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id",
        F.col("f").isNull().alias("passed"),
        F.col("f.check").alias("failed_check"),
        F.col("f.message").alias("message"),
    )


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of a text of each of the sizes; of size 0 the empty one."""
    def of(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def folded_terms(terms: DataFrame) -> DataFrame:
    """``(agent, ord, term, t)``: terms that fold to one text ``t`` are one, and the first of them answers for all."""
    return terms.where("term is not null").groupBy("agent", fold(F.col("term")).alias("t")).agg(
        F.min(F.struct("ord", "term")).alias("first")).select("agent", "first.ord", "first.term", "t")


def guard_questions(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``blocked_term``: the first of the agent's terms the question contains, ignoring case.

    ``terms(agent, ord, term)`` is authored and may be long. Each term is filed under the one of its trigrams that fewest questions hold (shorter
    terms under themselves); a question meets the terms filed under a trigram of its own, and ``contains`` decides. Equal questions
    of an agent are looked at once.
    """
    folded = folded_terms(terms)
    sizes = sorted(r[0] for r in folded.select(F.least(F.length("t"), F.lit(3))).distinct().collect())  # 0 to 3
    if not sizes:
        return questions.withColumn("blocked_term", F.lit(None).cast("string"))
    asked = questions.select("agent", "question", fold(F.col("question")).alias("q")).where("q is not null").distinct()
    texts = asked.select("agent", "q").distinct()
    held = texts.select("agent", "q", F.explode(_grams(F.col("q"), sizes)).alias("gram"))
    keys = folded.select("agent", "ord", "term", "t", F.explode(F.filter(
        _grams(F.col("t"), sizes), lambda g: F.length(g) == F.least(F.length("t"), F.lit(3)))).alias("gram"))
    common = held.join(keys.select("agent", "gram").distinct(), ["agent", "gram"], "left_semi").groupBy("agent", "gram").agg(F.count("*").alias("n"))
    # a term with a trigram that no question holds is in none of them
    filed = keys.join(common, ["agent", "gram"], "left").groupBy("agent", "ord", "term", "t").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).where("rarest.n > 0")
    met = held.join(filed.select("agent", F.col("rarest.gram").alias("gram"), "ord", "term", "t"), ["agent", "gram"]).where(F.contains("q", F.col("t")))
    first = met.groupBy("agent", "q").agg(F.min(F.struct("ord", "term")).alias("hit"))
    blocked = asked.join(first, ["agent", "q"]).select(F.col("agent").alias("_agent"), F.col("question").alias("_question"), F.col("hit.term").alias("blocked_term"))
    return questions.drop("blocked_term").join(
        blocked, (F.col("agent") == F.col("_agent")) & (F.col("question") == F.col("_question")), "left").drop("_agent", "_question")


def render_refs(templates: DataFrame, resources: DataFrame) -> DataFrame:
    """Replace template references by relation names: ``(template_id, manifest_digest, rendered, problem)``.

    ``templates(template_id, manifest_digest, text)``. A name must belong to exactly one queryable resource of the
    snapshot, and no other template syntax may remain.
    """
    none = F.lit("")
    relation = F.coalesce(
        F.nullif("relation_name", none), F.concat_ws(".", F.nullif("schema", none), F.nullif("alias", none))
    )
    targets = (
        resources.where("queryable")
        .groupBy("manifest_digest", F.col("name").alias("ref"))
        .agg(F.count("*").alias("n"), F.min(relation).alias("relation"))
    )
    pieces = F.split("text", fixed.REF_CALL)
    names = F.regexp_extract_all("text", F.lit(fixed.REF_CALL), F.lit(1))
    key = ["template_id", "manifest_digest"]
    rows = templates.select(
        *key,
        F.posexplode(F.zip_with(pieces, names, lambda p, n: F.struct(p.alias("piece"), n.alias("ref")))).alias(
            "pos", "z"
        ),
    ).select(*key, "pos", "z.piece", "z.ref")
    met = rows.join(targets, ["manifest_digest", "ref"], "left")
    lone = F.col("ref").isNull() | F.coalesce(F.col("n") == 1, F.lit(False))
    text = F.concat(F.coalesce("piece", none), F.coalesce(F.when(F.col("ref").isNotNull(), F.col("relation")), none))
    return (
        met.groupBy(*key)
        .agg(
            # as many parts as the template's own text has
            F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"),
            F.bool_or(F.contains("piece", F.lit("{{"))).alias("leftover"),
            F.min_by("ref", F.when(~lone, F.col("pos"))).alias("bad_ref"),
        )
        .select(
            *key,
            F.when(F.col("leftover"), "Only ref() is supported in reference queries")
            .when(F.col("bad_ref").isNotNull(), F.concat(F.lit("ref('"), "bad_ref", F.lit("') is ambiguous")))
            .alias("problem"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("rendered"),
        )
        .withColumn("rendered", F.when(F.col("problem").isNull(), F.col("rendered")))
    )
