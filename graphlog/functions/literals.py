"""Reading, writing and comparing JSON-literal property values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlog.model import DATA_TYPES


def quote(text: Column) -> Column:
    """Plain text to a JSON string literal; null stays null."""
    wrapped = F.to_json(F.array(text))
    return F.when(text.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def unquote(literal: Column) -> Column:
    """JSON literal to plain text; numbers and booleans keep their spelling."""
    inner = literal.substr(F.lit(2), F.length(literal) - 2)
    escaped = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]
    return (
        F.when(literal == "null", F.lit(None).cast("string"))
        .when(~literal.startswith('"'), literal)
        .when(F.instr(literal, "\\") == 0, inner)
        .otherwise(escaped)
    )


def literal_class(literal: Column) -> Column:
    """string, integer, boolean or null.

    Numbers with a fraction or exponent count as strings, as they do in the
    shape check this feeds.
    """
    return (
        F.when(literal.isNull() | (literal == "null"), F.lit("null"))
        .when(literal.isin("true", "false"), F.lit("boolean"))
        .when(literal.rlike("^-?[0-9]+$"), F.lit("integer"))
        .otherwise(F.lit("string"))
    )


def typed(literal: Column, data_type: str, strict: bool = False) -> Column:
    """Cast a literal to the Spark type its registry name stands for."""
    target = DATA_TYPES.get((data_type or "").lower(), DATA_TYPES["string"])
    text = unquote(literal)
    return text.cast(target) if strict else text.try_cast(target)


def canonical_json(props: Column) -> Column:
    """Compact JSON text of a property map with its keys sorted."""
    pairs = F.transform(
        F.array_sort(F.map_entries(props)),
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.coalesce(e["value"], F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def overlay(*maps: Column) -> Column:
    """Merge maps left to right; a later map wins on equal keys.

    Written without ``map_concat`` so that it does not depend on the session's
    duplicate-key policy.
    """
    merged = maps[0]
    for top in maps[1:]:
        merged = _on_top(merged, top)
    return merged


def _on_top(below: Column, above: Column) -> Column:
    kept = F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k))
    return F.when(above.isNull(), below).when(below.isNull(), above).otherwise(F.map_concat(kept, above))


def put_if_absent(props: Column, derived: Column) -> Column:
    return overlay(derived, props)
