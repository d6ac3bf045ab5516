"""Typed tables over node state, one per tenant and type."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.functions.literals import typed

SYSTEM = ["node", "model_id", "type", "created_at", "updated_at", "created_by", "seq"]


def type_columns(registry: DataFrame, model_id: str, node_type: str) -> list[tuple[str, str]]:
    """(name, data type) of a type's live properties: one row per column."""
    rows = registry.filter((F.col("model_id") == model_id) & (F.col("type") == node_type) & F.col("deprecated_at").isNull())
    return [(r[0], r[1]) for r in rows.select("property", "data_type").orderBy("property").collect()]


def typed_view(nodes: DataFrame, columns: list[tuple[str, str]], model_id: str, node_type: str, strict: bool = False) -> DataFrame:
    """System columns and one cast column per property; tombstones left out.

    A value that does not cast reads null, or fails the query if ``strict``.
    """
    rows = nodes.filter((F.col("model_id") == model_id) & (F.col("type") == node_type) & ~F.coalesce("tombstoned", F.lit(False)))
    return rows.select(*SYSTEM, *[typed(F.col("props")[name], kind, strict).alias(name) for name, kind in columns])


def view_name(model_id: str, node_type: str) -> str:
    """A readable name, told apart from like ones by a hash of what it stands for."""
    code = hashlib.sha256(f"{len(model_id)}:{model_id}{node_type}".encode()).hexdigest()[:10]
    return re.sub(r"\W", "_", f"v_{model_id}_{node_type}").lower() + f"_{code}"


def refresh_views(spark: SparkSession, nodes: DataFrame, types: DataFrame, registry: DataFrame,
                  recorded: dict[str, int] | None = None) -> dict[str, int]:
    """(Re)build the views of exposed types whose schema version moved.

    ``recorded`` maps view names to the version they were built from; the new
    record is returned. Only registry rows reach the driver.
    """
    recorded = dict(recorded or {})
    exposed = types.filter("exposed").select("model_id", "type", "schema_version")
    live = registry.filter(F.col("deprecated_at").isNull()).select("model_id", "type", "property", "data_type")
    columns: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for model_id, node_type, name, kind in live.join(exposed, ["model_id", "type"], "left_semi").collect():
        columns.setdefault((model_id, node_type), []).append((name, kind))
    for model_id, node_type, version in exposed.collect():
        name = view_name(model_id, node_type)
        if recorded.get(name) == version:
            continue
        typed_view(nodes, sorted(columns.get((model_id, node_type), [])), model_id, node_type).createOrReplaceTempView(name)
        recorded[name] = version
    return recorded
