"""A JSON schema as one Column expression over a VARIANT."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {
    "object": "^OBJECT",
    "array": "^ARRAY",
    "string": "^STRING",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN",
    "null": "^VOID",
}


def violation(value: Column, schema: dict[str, Any], path: Column | str = "$") -> Column:
    """First violation of the schema as text, NULL when there is none.

    The schema is walked here, on the driver; it supports ``type`` (also several), ``required``,
    ``properties``, ``additionalProperties: false`` and ``items``.
    """
    path = path if isinstance(path, Column) else F.lit(path)
    wanted = schema.get("type")
    allowed = [wanted] if isinstance(wanted, str) else list(wanted or [])
    found = F.schema_of_variant(value)

    def say(*parts: Column | str) -> Column:
        return F.concat(
            F.lit("Structured output "), path, *[p if isinstance(p, Column) else F.lit(p) for p in parts]
        )

    rules: list[Column] = []
    if allowed:
        patterns = [_TYPES[t] for t in allowed if t in _TYPES]
        fits = F.lit(False)
        for pattern in patterns:
            fits = fits | found.rlike(pattern)
        rules.append(F.when(~fits, say(" must have type " + " or ".join(allowed))))
    if "object" in allowed:
        rules.append(F.when(found.rlike(_TYPES["object"]), _object_violation(value, schema, path, say)))
    if "array" in allowed and isinstance(schema.get("items"), dict):
        items = F.try_variant_get(value, "$", "array<variant>")
        problems = F.transform(
            items,
            lambda item, i: violation(
                item, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            ),
        )
        first = F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))
        rules.append(F.when(found.rlike(_TYPES["array"]), first))
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def _object_violation(value: Column, schema: dict[str, Any], path: Column, say) -> Column:
    members = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    properties: dict[str, Any] = schema.get("properties") or {}
    required = list(schema.get("required") or [])
    rules: list[Column] = []
    if required:
        missing = F.filter(
            F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(members, r)
        )
        rules.append(F.when(F.size(missing) > 0, say(" is missing: ", F.array_join(missing, ", "))))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(p) for p in properties]).cast("array<string>")
        extra = F.array_sort(F.array_except(members, known))
        rules.append(F.when(F.size(extra) > 0, say(" has unexpected fields: ", F.array_join(extra, ", "))))
    for name, part in properties.items():
        member = F.variant_get(value, f"$['{name}']", "variant")
        inner = violation(member, part, F.concat(path, F.lit(f".{name}")))
        rules.append(F.when(F.array_contains(members, name), inner))
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")
