"""Selectors, scopes, lineage closure and the quality of a scope's metadata.

``resources`` and ``edges`` are as made by ``operators.resources``; ``agents(agent, include_parents,
include_children)`` and ``selectors(agent, selector, is_exclude)`` are authored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.variants import relation_key
from plumbline.operators.joins import dealt_distinct, hashed_join
from plumbline.session import stored


def _padded(number: Column, width: int = 6) -> Column:
    """At least ``width`` digits with leading zeros; longer numbers are not cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def resource_keys(resources: DataFrame) -> DataFrame:
    """Every ``(kind, value)`` under which a selector reaches a queryable resource.

    Folders end in a slash, so that matching a path below a folder is an equality.
    """
    r = resources.where("queryable")
    parts = F.split("path", "/")
    folders = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    uid, is_model = F.col("unique_id"), F.col("resource_type") == "model"
    dots = F.split(uid, r"\.")
    plain = F.array(
        key("group", F.col("grp")),
        key("package", F.col("package")),
        key("path", F.col("path")),
        key("model", F.when(is_model, F.col("name"))),
        key("model", F.when(is_model, uid)),
        key("model", F.when(is_model, F.concat("package", F.lit("."), "name"))),
    )
    others = F.concat(
        plain,
        F.transform("tags", lambda t: key("tag", t)),
        F.transform(folders, lambda p: key("path", p)),
    )
    sources = F.array(
        key("source", uid), key("source", F.array_join(F.slice(dots, F.greatest(F.size(dots) - 1, F.lit(1)), 2), "."))
    )
    keys = F.when(F.col("resource_type") == "source", sources).otherwise(others)
    return (
        r.select("manifest_digest", "unique_id", F.explode(F.array_distinct(keys)).alias("k"))
        .where(F.col("k.value").isNotNull() & (F.col("k.value") != ""))
        .select("manifest_digest", "unique_id", "k.kind", "k.value")
    )


def parse_selectors(selectors: DataFrame) -> DataFrame:
    """Adds ``kind``, ``value`` and ``problem``."""
    text = F.col("selector")
    has = F.contains(text, F.lit(":"))
    kind = F.when(has, F.trim(F.substring_index(text, ":", 1)))
    value = F.when(has, F.trim(F.expr("substring(selector, instr(selector, ':') + 1)")))
    return selectors.withColumns({"kind": kind, "value": value}).withColumn(
        "problem",
        F.when(~has, "expected type:value").when(
            ~F.col("kind").isin(*fixed.SELECTOR_KINDS) | (F.col("value") == ""), "unsupported selector"
        ),
    )


def match_selectors(resources: DataFrame, selectors: DataFrame) -> DataFrame:
    """``(agent, is_exclude, selector, manifest_digest, unique_id)`` by one equi-join."""
    parsed = parse_selectors(selectors).where(F.col("problem").isNull())
    folder = F.concat(F.rtrim("value", F.lit("/")), F.lit("/"))
    forms = F.when(F.col("kind") == "path", F.array(F.col("value"), folder)).otherwise(F.array("value"))
    wanted = parsed.select(
        "agent", "is_exclude", "selector", "kind", F.explode(F.array_distinct(forms)).alias("value")
    )
    return (
        resource_keys(resources)
        .join(wanted, ["kind", "value"])
        .select("agent", "is_exclude", "selector", "manifest_digest", "unique_id")
        .distinct()
    )


def unmatched_selectors(resources: DataFrame, selectors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Selectors that are malformed, or reach nothing in a snapshot of their agent; an exclusion may reach nothing.

    ``snapshots(agent, manifest_digest)``. A malformed selector is so in every snapshot and has no digest.
    """
    keys = resource_keys(resources).select("manifest_digest", "kind", "value").distinct()
    parsed = parse_selectors(selectors)
    bad = parsed.where(F.col("problem").isNotNull()).select("agent", F.lit(None).cast("string").alias("manifest_digest"), "selector", "problem")
    folder = F.concat(F.rtrim("value", F.lit("/")), F.lit("/"))
    forms = F.when(F.col("kind") == "path", F.array(F.col("value"), folder)).otherwise(F.array("value"))
    good = parsed.where(F.col("problem").isNull() & ~F.col("is_exclude")).join(snapshots.select("agent", "manifest_digest").distinct(), "agent")
    hit = (
        good.select("agent", "manifest_digest", "selector", "kind", F.explode(forms).alias("value"))
        .join(keys, ["manifest_digest", "kind", "value"], "left_semi")
        .select("agent", "manifest_digest", "selector")
    )
    return bad.unionByName(
        good.join(hit, ["agent", "manifest_digest", "selector"], "left_anti").select(
            "agent", "manifest_digest", "selector", F.lit("matched no queryable resources").alias("problem")
        )
    )


def closure(
    edges: DataFrame,
    starts: DataFrame,
    direction: str,
    resources: DataFrame | None = None,
    keys: Sequence[str] = ("start",),
) -> DataFrame:
    """Everything reached over one or more edges from ``starts(*keys, manifest_digest, unique_id)``.

    The starts that share their keys are one set, and sets are numbered. A vertex has a row for every 64 numbers it is reached from, whose
    bits say from which, not a row for each: a round sends the bits that are new along the edges and ORs them at the other end. Cycles end
    by themselves, since a round without a new bit is the last. State is written to reliable storage round by round. Only known
    resources are walked through. 'up' follows declared dependencies; 'down' follows every edge.
    """
    if direction == "up":
        hops = edges.where("declared").select("manifest_digest", F.col("child_id").alias("unique_id"), F.col("parent_id").alias("next"))
    elif direction == "down":
        hops = edges.select("manifest_digest", F.col("parent_id").alias("unique_id"), F.col("child_id").alias("next"))
    else:
        raise ValueError("direction must be 'up' or 'down'")
    if resources is not None:
        hops = hashed_join(hops, resources.select("manifest_digest", "unique_id"), ["manifest_digest", "unique_id"], "left_semi")
    hops = stored(dealt_distinct(hops), "hops")
    numbered = stored(starts.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), "starts")
    vertex = ["manifest_digest", "unique_id", "_word"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_id") % 64).cast("int"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    marked = starts.alias("s").join(numbered.alias("n"), same).select("manifest_digest", "unique_id", F.floor(F.col("_id") / 64).alias("_word"), bit.alias("_bits"))
    front = marked.groupBy(*vertex).agg(F.bit_or("_bits").alias("_bits"))
    reached: DataFrame | None = None
    while True:
        step = hashed_join(front, hops, ["manifest_digest", "unique_id"]).groupBy("manifest_digest", F.col("next").alias("unique_id"), "_word").agg(F.bit_or("_bits").alias("_bits"))
        if reached is not None:
            step = hashed_join(step, reached.withColumnRenamed("_bits", "_known"), vertex, "left").select(*vertex, F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))).alias("_bits"))
            step = step.where("_bits <> 0")
        front = stored(step, "closure")
        if front.isEmpty():
            break
        reached = front if reached is None else stored(reached.unionByName(front).groupBy(*vertex).agg(F.bit_or("_bits").alias("_bits")), "closure")
    found = front if reached is None else reached
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.call_function("getbit", F.col("_bits"), p) == 1)
    pairs = found.select("manifest_digest", "unique_id", F.explode(places).alias("_place"), "_word").withColumn("_id", F.col("_word") * 64 + F.col("_place"))
    return pairs.join(numbered, "_id").select(*keys, "manifest_digest", "unique_id")


def _askable(reached: DataFrame, resources: DataFrame) -> DataFrame:
    """Lineage never grants sources, nor anything that cannot be queried."""
    open_ids = resources.where(F.col("queryable") & (F.col("resource_type") != "source")).select(
        "manifest_digest", "unique_id"
    )
    return hashed_join(reached, open_ids, ["manifest_digest", "unique_id"], "left_semi")


def expand_scope(
    chosen: DataFrame, agents: DataFrame, resources: DataFrame, edges: DataFrame
) -> DataFrame:
    """Add parents, then children of the already widened set, for the agents that ask for them."""
    columns = ["agent", "manifest_digest", "unique_id"]
    asks = lambda flag: agents.where(flag).select("agent")
    up = asks("include_parents")
    scope = chosen.select(*columns)
    starts = scope.join(up, "agent", "left_semi")
    parents = _askable(closure(edges, starts, "up", resources, ["agent"]), resources).select(*columns)
    scope = scope.unionByName(parents).distinct()
    starts = scope.join(asks("include_children"), "agent", "left_semi")
    children = _askable(closure(edges, starts, "down", resources, ["agent"]), resources).select(*columns)
    return scope.unionByName(children).distinct()


def resolve_scope(
    agents: DataFrame, selectors: DataFrame, resources: DataFrame, edges: DataFrame | None = None
) -> DataFrame:
    """``scopes(agent, manifest_digest, unique_id)``: matches, widened along the lineage, less exclusions."""
    matches = match_selectors(resources, selectors)
    columns = ["agent", "manifest_digest", "unique_id"]
    scope = matches.where(~F.col("is_exclude")).select(*columns).distinct()
    if edges is not None:
        scope = expand_scope(scope, agents, resources, edges)
    return scope.join(matches.where("is_exclude").select(*columns), columns, "left_anti")


def empty_scopes(agents: DataFrame, scopes: DataFrame) -> DataFrame:
    return agents.select("agent").join(scopes.select("agent"), "agent", "left_anti")


def relation_keys(scopes: DataFrame, resources: DataFrame) -> DataFrame:
    """Per agent, snapshot and normalised relation name: how many resources carry it, and one of them."""
    names = F.array(
        F.col("name"),
        F.col("alias"),
        F.col("relation_name"),
        F.when(F.col("schema") != "", F.concat_ws(".", "schema", "alias")),
        F.when((F.col("database") != "") & (F.col("schema") != ""), F.concat_ws(".", "database", "schema", "alias")),
    )
    # dealt out by name before anything is held: hardly two rows are alike, so tasks over the files would only gather them
    named = (
        hashed_join(scopes.select("agent", "manifest_digest", "unique_id"), resources, ["manifest_digest", "unique_id"])
        .select("agent", "manifest_digest", "unique_id", F.explode(F.array_distinct(names)).alias("relation"))
        .where(F.col("relation") != "")
        .select("agent", "manifest_digest", "unique_id", relation_key(F.col("relation")).alias("relation"))
        .withColumn("_hash", F.xxhash64("agent", "manifest_digest", "relation"))
        .repartition("_hash")
        .distinct()
    )
    return named.groupBy("_hash", "agent", "manifest_digest", "relation").agg(
        F.count("*").alias("n_matches"), F.min("unique_id").alias("unique_id")
    ).drop("_hash")


def resolve_relations(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """References ``(query_id, ord, agent, manifest_digest, ref)`` with ``status`` and, when clear, ``unique_id``.

    ``keys`` holds one row per agent, snapshot and name, so a reference meets at most one row. A query from before the first snapshot
    has no digest, and nothing is in its scope.
    """
    r = refs.withColumn("relation", relation_key(F.col("ref")))
    return hashed_join(r, keys, ["agent", "manifest_digest", "relation"], "left").select(
        *[c for c in refs.columns],
        F.when(F.col("n_matches").isNull(), "out_of_scope")
        .when(F.col("n_matches") > 1, "ambiguous")
        .otherwise("resolved")
        .alias("status"),
        F.when(F.col("n_matches") == 1, F.col("unique_id")).alias("unique_id"),
    )


def duplicate_aliases(scopes: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources of a scope that share an alias, ignoring case: ``(agent, alias, unique_id)``."""
    named = scopes.join(
        resources.select("manifest_digest", "unique_id", F.lower("alias").alias("alias")),
        ["manifest_digest", "unique_id"],
    ).select("agent", "manifest_digest", "alias", "unique_id")
    shared = (
        named.groupBy("agent", "manifest_digest", "alias").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return named.join(shared, ["agent", "manifest_digest", "alias"], "left_semi")


def ancestors(scopes: DataFrame, edges: DataFrame, resources: DataFrame) -> DataFrame:
    """``(manifest_digest, unique_id, ancestor_id)`` for the resources in any scope."""
    starts = scopes.select("manifest_digest", "unique_id").distinct().withColumn("start", F.col("unique_id"))
    return closure(edges, starts, "up", resources).select(
        "manifest_digest", F.col("start").alias("unique_id"), F.col("unique_id").alias("ancestor_id")
    )


def undocumented(columns: DataFrame) -> DataFrame:
    """Resources with a column that lacks a description: the only ones whose ancestors matter."""
    return dealt_distinct(columns.where(F.col("description") == "").select("manifest_digest", "unique_id"))


def inherit_descriptions(columns: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Descriptions for undocumented columns whose ancestors agree on exactly one."""
    bare = columns.where(F.col("description") == "").select("manifest_digest", "unique_id", "column_name")
    told = columns.where(F.trim("description") != "").select(
        "manifest_digest",
        F.col("unique_id").alias("ancestor_id"),
        "column_name",
        "description",
    )
    return (
        hashed_join(hashed_join(bare, ancestors, ["manifest_digest", "unique_id"]), told, ["manifest_digest", "ancestor_id", "column_name"])
        .groupBy("manifest_digest", "unique_id", "column_name")
        .agg(F.min("description").alias("description"), F.max("description").alias("other"))
        .where(F.col("description") == F.col("other"))
        .drop("other")
    )


def missing_descriptions(
    scopes: DataFrame, resources: DataFrame, columns: DataFrame, inherited: DataFrame
) -> DataFrame:
    """Undocumented resources and columns per agent and snapshot: ``(agent, manifest_digest, unique_id, column_name)``."""
    key = ["manifest_digest", "unique_id"]
    nodes = resources.where(F.col("description") == "").select(*key, F.lit(None).cast("string").alias("column_name"))
    bare = columns.where(F.col("description") == "").select(*key, "column_name")
    bare = hashed_join(bare, inherited, [*key, "column_name"], "left_anti")
    return hashed_join(scopes, nodes.unionByName(bare), key).select("agent", *key, "column_name")


def selector_facets(resources: DataFrame, kind: str) -> DataFrame:
    """Selectable values of a kind: ``(manifest_digest, value, label, n_resources)``."""
    if kind not in fixed.SELECTOR_KINDS:
        raise ValueError(f"Unsupported selector type '{kind}'")
    r = resources.where("queryable")
    own = r.where(F.col("resource_type") == "source") if kind == "source" else r.where(F.col("resource_type") != "source")
    uid = F.split("unique_id", r"\.")
    path = F.col("path")
    fallback = lambda first, second: F.coalesce(F.nullif(first, F.lit("")), second)
    value, label = {
        "group": (F.col("grp"), F.lit("dbt group")),
        "tag": (F.explode("tags"), F.lit("dbt tag")),
        "model": (
            F.when(F.col("resource_type") == "model", F.concat("package", F.lit("."), "name")),
            fallback(F.col("description"), F.col("relation_name")),
        ),
        "path": (F.when(path != "", F.regexp_replace(path, "/[^/]*$", "")), F.lit("dbt model path")),
        "package": (F.col("package"), F.lit("dbt package")),
        "source": (
            F.array_join(F.slice(uid, F.greatest(F.size(uid) - 1, F.lit(1)), 2), "."),
            fallback(F.col("description"), F.col("alias")),
        ),
    }[kind]
    values = (
        own.select("manifest_digest", value.alias("value"), label.alias("label"))
        .where(F.col("value").isNotNull())
        .groupBy("manifest_digest", "value")
        .agg(F.max("label").alias("label"))
    )
    keys = resource_keys(resources).where(F.col("kind") == kind)
    if kind == "path":
        keys = keys.withColumn("value", F.rtrim("value", F.lit("/")))
    counts = keys.groupBy("manifest_digest", "value").agg(F.count("*").alias("n_resources"))
    return values.join(counts, ["manifest_digest", "value"])


def scope_report(
    scopes: DataFrame,
    resources: DataFrame,
    columns: DataFrame,
    tests: DataFrame,
    edges: DataFrame,
    inherited: DataFrame,
) -> DataFrame:
    """Text report as lines ``(agent, unique_id, section, item, line)``.

    Sections are ordered by number. Lists of any length (columns, tests, neighbours) give one line
    per item, so no resource is ever gathered into a single value.
    """
    key = ["manifest_digest", "unique_id"]
    mine = scopes.select("agent", *key)

    def lines(df: DataFrame, section: str, item: Column, line: Column) -> DataFrame:
        return df.select(*key, F.lit(section).alias("section"), item.cast("string").alias("item"), line.alias("line"))

    none = F.lit("")
    relation = F.coalesce(F.nullif("relation_name", none), F.concat_ws(".", F.nullif("schema", none), "alias"))
    pairs = [(n, n) for n in ("materialized", "access")] + [("group", "grp"), ("owner", "owner"), ("package", "package")]
    metadata = F.concat_ws(
        ", ", *[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{n}="), c)) for n, c in pairs]
    )
    known = columns.join(
        inherited.select(*key, "column_name", F.col("description").alias("upstream")),
        [*key, "column_name"],
        "left",
    )
    kind = F.coalesce("physical_type", "data_type")
    column_line = F.concat_ws(
        " ",
        "column_name",
        F.when(kind.isNotNull(), F.concat(F.lit("["), kind, F.lit("]"))),
        F.when(F.col("description") != "", F.concat(F.lit("— "), "description")).when(
            F.col("upstream").isNotNull(), F.concat(F.lit("— upstream metadata: "), "upstream")
        ),
    )
    up = edges.where("declared").select("manifest_digest", F.col("child_id").alias("unique_id"), F.col("parent_id").alias("other"))
    down = edges.select("manifest_digest", F.col("parent_id").alias("unique_id"), F.col("child_id").alias("other"))
    by_target = tests.withColumnRenamed("target_id", "unique_id")
    arguments = F.to_json("arguments")
    test_line = F.when(
        arguments.isNotNull() & (arguments != "{}"), F.concat("name", F.lit("("), arguments, F.lit(")"))
    ).otherwise(F.col("name"))
    constraint = resources.select(*key, F.posexplode("constraints").alias("n", "constraint"))
    joins = resources.select(*key, F.to_json(F.try_element_at("meta", F.lit("joins"))).alias("joins"))
    parts = [
        lines(resources, "0 resource", none, relation),
        lines(resources, "1 metadata", none, metadata),
        lines(resources.where("description <> ''"), "2 description", none, F.col("description")),
        lines(up, "3 upstream", F.col("other"), F.col("other")),
        lines(down, "4 downstream", F.col("other"), F.col("other")),
        lines(known, "5 column", _padded(F.col("ordinal")), column_line),
        lines(by_target, "6 test", F.col("test_id"), test_line),
        lines(constraint, "7 constraint", F.col("n"), F.to_json("constraint")),
        lines(joins.where("joins is not null"), "8 joins", none, F.col("joins")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return mine.join(report, key).select("agent", "unique_id", "section", "item", "line")


def resource_details(
    scopes: DataFrame, resources: DataFrame, columns: DataFrame, tests: DataFrame
) -> DataFrame:
    """Nested details per resource of a scope: its columns (as wide as a table) and its tests."""
    key = ["manifest_digest", "unique_id"]
    cols = columns.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(F.struct("ordinal", "column_name", "data_type", "physical_type", "description"))
        ).alias("columns")
    )
    checks = (
        tests.withColumnRenamed("target_id", "unique_id")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("test_id", "name", "column_name", "status"))).alias("tests"))
    )
    return scopes.join(resources, key).join(cols, key, "left").join(checks, key, "left")


def catalog_coverage(columns: DataFrame, resources: DataFrame) -> DataFrame:
    """Known physical types among the columns of queryable resources, per manifest."""
    open_ids = resources.where("queryable").select("manifest_digest", "unique_id")
    return (
        columns.join(open_ids, ["manifest_digest", "unique_id"], "left_semi")
        .groupBy("manifest_digest")
        .agg(
            F.count("*").alias("n_columns"),
            F.count_if(F.col("physical_type").isNotNull()).alias("n_physical"),
        )
    )


def agent_sizes(agents: DataFrame, scopes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Resources per agent and snapshot; a name declared more than once is a problem.

    ``snapshots(agent, manifest_digest)``; an agent without a snapshot has one row without a digest.
    """
    key = ["agent", "manifest_digest"]
    declared = agents.groupBy("agent").agg(F.count("*").alias("n_declared"))
    sizes = scopes.groupBy(*key).agg(F.count("*").alias("n_resources"))
    n = F.coalesce("n_resources", F.lit(0))
    return declared.join(snapshots.select(*key).distinct(), "agent", "left").join(sizes, key, "left").select(
        *key,
        n.alias("n_resources"),
        F.when(F.col("n_declared") > 1, "duplicated").when(n == 0, "empty scope").alias("problem"),
    )


def missing_agents(wanted: DataFrame, agents: DataFrame) -> DataFrame:
    """Agent names that are used but not declared."""
    return wanted.select("agent").distinct().join(agents.select("agent"), "agent", "left_anti")
