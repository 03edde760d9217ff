"""Reading semi-structured documents (VARIANT) with the looseness artifacts need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """The document a text holds, or NULL; unlike the plain parser it refuses anything after the value.

    The text has to be well-formed both as the only element of an array and as a member of an object. The array is bound to a
    name, so that it is parsed once, and only looked up: a cast to its elements would build each of them anew.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))

    def only(elements: Column) -> Column:
        alone = F.variant_get(elements, "$[1]", "variant").isNull()
        return F.when(alone & as_member.isNotNull(), F.variant_get(elements, "$[0]", "variant"))

    return F.get(F.transform(F.array(as_element), only), F.lit(0))


def text_at(doc: Column, *paths: str) -> Column:
    """First non-empty scalar among the paths, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(doc, p, "string"), F.lit("")) for p in paths])


def strings_at(doc: Column, path: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.try_variant_get(doc, path, "array<string>"), empty)


def map_at(doc: Column, path: str) -> Column:
    empty = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(doc, path, "map<string,variant>"), empty)


def is_object(doc: Column) -> Column:
    """Whether a value has members; they are not looked into, as the schema of a document would."""
    return F.try_variant_get(doc, "$", "struct<_:boolean>").isNotNull()


def objects_at(doc: Column, path: str) -> Column:
    """The objects among an array's elements."""
    empty = F.array().cast("array<variant>")
    return F.filter(F.coalesce(F.try_variant_get(doc, path, "array<variant>"), empty), is_object)


def flag_at(doc: Column, path: str, missing: bool) -> Column:
    """Truth of a value: a missing one gives the default, an explicit null is false."""
    value = F.variant_get(doc, path, "variant")
    return (
        F.when(value.isNull(), F.lit(missing))
        .when(F.is_variant_null(value), F.lit(False))
        .otherwise(F.coalesce(F.try_variant_get(doc, path, "boolean"), F.lit(True)))
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def unquote(part: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(part, F.lit(""))), r"^[\"`\[\]]+|[\"`\[\]]+$", "")


def relation_key(name: Column) -> Column:
    """Lower-case dotted name without quotes or blank parts.

    Almost all names need no look at their parts: no part of theirs is blank, and their quotes, if any, are double ones at borders of parts.
    """
    has = lambda text, mark: F.contains(text, F.lit(mark))
    unusual = has(name, " ") | has(name, "..") | has(name, "`") | has(name, "[") | has(name, "]") | F.startswith(name, F.lit(".")) | F.endswith(name, F.lit("."))
    bare = name
    for marks in ('"."', '".', '."'):
        bare = F.replace(bare, F.lit(marks), F.lit("."))
    bare = F.btrim(bare, F.lit('"'))
    parts = F.filter(F.split(name, r"\."), lambda p: F.trim(p) != "")
    return (
        F.when(~unusual & ~has(name, '"'), F.lower(name))
        .when(~unusual & ~has(bare, '"'), F.lower(bare))
        .otherwise(F.array_join(F.transform(parts, lambda p: F.lower(unquote(p))), "."))
    )


def overlay(base: Column, top: Column) -> Column:
    """Union of two maps; entries of ``top`` win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(top), k)), top)
