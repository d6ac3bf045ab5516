"""Checking mutations against the registered shape of their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import literal_class, overlay, unquote
from graphlog.model import UUID_FORM

# Constraint names and severity in a report.
MIN_COUNT = "MinCountConstraintComponent"
DATATYPE = "DatatypeConstraintComponent"
PATTERN = "PatternConstraintComponent"
SEVERITY = "Violation"


def type_shapes(registry: DataFrame) -> DataFrame:
    """One row per (tenant, type) with its properties as an array."""
    entry = F.struct("property", F.lower(F.coalesce("data_type", F.lit(""))).alias("data_type"), "required")
    return registry.groupBy("model_id", "type").agg(F.sort_array(F.collect_list(entry)).alias("_shape"))


def _faults(payload: Column) -> Column:
    def check(p: Column) -> Column:
        value = payload[p["property"]]
        kind = literal_class(value)
        want = p["data_type"]
        there = kind != "null"
        wrong = (
            F.when(want == "string", kind != "string")
            .when(want.isin("int", "integer"), kind != "integer")
            .when(want == "boolean", kind != "boolean")
            .when(want.isin("instant", "datetime"), (kind != "string") | F.try_to_timestamp(unquote(value)).isNull())
            .when(want == "uuid", kind != "string")
            .otherwise(F.lit(False))
        )
        malformed = (want == "uuid") & ~unquote(value).rlike(UUID_FORM)
        return F.array(
            F.when(p["required"] & ~there, F.lit(MIN_COUNT)),
            F.when(there & wrong, F.lit(DATATYPE)),
            F.when(there & malformed, F.lit(PATTERN)),
        )

    named = F.transform(
        F.col("_shape"),
        lambda p: F.transform(
            F.array_compact(check(p)),
            lambda c: F.struct(p["property"].alias("path"), c.alias("constraint"), F.lit(SEVERITY).alias("severity")),
        ),
    )
    return F.flatten(named)


def check_shapes(mutations: DataFrame, registry: DataFrame, scope: str = "payload", state: Column | None = None) -> DataFrame:
    """Add ``violations``: paths and constraint names, never a value.

    Unregistered types conform. ``scope="merged"`` checks the payload over
    ``state``, the node's properties before the mutation.
    """
    payload = F.col("payload")
    if scope == "merged":
        payload = overlay(state, payload)
    elif scope != "payload":
        raise ValueError(f"unknown scope: {scope}")
    joined = mutations.join(type_shapes(registry), ["model_id", "type"], "left")
    empty = F.array().cast("array<struct<path:string,constraint:string,severity:string>>")
    return joined.withColumn("violations", F.coalesce(_faults(payload), empty)).select(*mutations.columns, "violations")


def report(checked: DataFrame) -> DataFrame:
    """One row per violation, keyed by the node it concerns."""
    row = F.explode("violations").alias("v")
    return checked.select("model_id", F.coalesce("node", F.lit("")).alias("focus"), "seq", row).select(
        "model_id", "focus", "seq", "v.path", "v.constraint", "v.severity"
    )


def rejected(checked: DataFrame, reason: Column, detail: Column, rule_id: Column) -> DataFrame:
    """Dead letters: refused mutations of connectors, with their envelope."""
    envelope = [c for c in checked.columns if c not in ("violations",)]
    rows = checked.filter(reason.isNotNull() & F.col("origin_connector_id").isNotNull())
    return rows.select(
        "model_id",
        F.col("origin_connector_id").alias("connector_id"),
        "origin_change_id",
        "seq",
        reason.alias("reason"),
        detail.alias("detail"),
        rule_id.alias("rule_id"),
        F.to_json(F.struct(*[F.col(c) for c in envelope])).alias("raw_payload"),
    )
