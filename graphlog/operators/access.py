"""What a caller's roles may read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_to(roles: Column, caller: list[str]) -> Column:
    """True when no role is asked for or the caller holds one of them."""
    held = F.array(*[F.lit(r) for r in caller]).cast("array<string>")
    listed = F.coalesce(roles, F.array().cast("array<string>"))
    return (F.size(listed) == 0) | F.arrays_overlap(listed, held)


def filter_properties(nodes: DataFrame, properties: DataFrame, caller: list[str], column: str = "props") -> DataFrame:
    """Keep the registered properties the caller may read; drop the rest."""
    allowed = properties.filter(open_to(F.col("read_roles"), caller)).groupBy("model_id", "type").agg(
        F.collect_set("property").alias("_allowed")
    )
    joined = nodes.join(allowed, ["model_id", "type"], "left")
    none = F.array().cast("array<string>")
    kept = F.map_filter(column, lambda k, v: F.array_contains(F.coalesce("_allowed", none), k))
    return joined.withColumn(column, kept).select(*nodes.columns)


def visible_types(types: DataFrame, caller: list[str]) -> DataFrame:
    return types.filter(open_to(F.col("read_roles"), caller))


def check_writes(mutations: DataFrame, properties: DataFrame, caller: list[str], column: str = "payload") -> DataFrame:
    """Add ``denied``: payload keys the caller lacks the write role for."""
    closed = properties.filter(~open_to(F.col("write_roles"), caller)).groupBy("model_id", "type").agg(
        F.collect_set("property").alias("_closed")
    )
    joined = mutations.join(closed, ["model_id", "type"], "left")
    denied = F.array_sort(F.array_intersect(F.map_keys(column), F.coalesce("_closed", F.array().cast("array<string>"))))
    return joined.withColumn("denied", denied).select(*mutations.columns, "denied")
