"""The schema registry: versions, history, aliases, breaking changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import overlay
from graphlog.operators.runs import numbered

# Change types that add or take away a property.
ADD = "ADD_PROPERTY"
GONE = ["REMOVE_PROPERTY", "DEPRECATE_PROPERTY"]


def versions(changes: DataFrame) -> DataFrame:
    """Number each tenant's schema changes: one version per change."""
    return numbered(changes, "model_id", ["event_time", "change_id"], out="version")


def current_version(versioned: DataFrame) -> DataFrame:
    return versioned.groupBy("model_id").agg(F.max("version").alias("version"))


def descriptor_at(versioned: DataFrame, version: int) -> DataFrame:
    """Properties of every type as of a version: each one's last change counts."""
    last = versioned.filter(F.col("version") <= version).groupBy("model_id", "type", "property").agg(
        F.max_by("change_type", "version").alias("change_type"), F.max("version").alias("since")
    )
    return last.filter(~F.col("change_type").isin(GONE)).select("model_id", "type", "property", "since")


def net_property_counts(versioned: DataFrame, version: int) -> DataFrame:
    """Additions less removals per type as of a version."""
    step = F.when(F.col("change_type") == ADD, 1).when(F.col("change_type").isin(GONE), -1).otherwise(0)
    past = versioned.filter(F.col("version") <= version)
    return past.groupBy("model_id", "type").agg(F.sum(step).alias("net"))


def current_aliases(aliases: DataFrame) -> DataFrame:
    """Old to current name; the last write of an old name wins."""
    return aliases.groupBy("model_id", "type", "old_slug").agg(F.max_by("current_slug", "changed_at").alias("current_slug"))


def resolve_alias(rows: DataFrame, aliases: DataFrame, column: str = "property") -> DataFrame:
    """Replace an old name by its current one, one step."""
    known = current_aliases(aliases).withColumnRenamed("old_slug", column)
    joined = rows.join(known, ["model_id", "type", column], "left")
    return joined.withColumn(column, F.coalesce("current_slug", column)).select(*rows.columns)


def rename_properties(rows: DataFrame, aliases: DataFrame, column: str = "payload") -> DataFrame:
    """Rename old keys of a property map; a value under the current name wins."""
    per_type = current_aliases(aliases).groupBy("model_id", "type").agg(
        F.map_from_entries(F.collect_list(F.struct("old_slug", "current_slug"))).alias("_names")
    )
    joined = rows.join(per_type, ["model_id", "type"], "left")
    names = F.coalesce("_names", F.create_map().cast("map<string,string>"))
    old = F.array_sort(F.map_entries(F.map_filter(column, lambda k, v: F.map_contains_key(names, k))))
    renamed = F.aggregate(
        old,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != names[e["key"]]), F.create_map(names[e["key"]], e["value"])
        ),
    )
    kept = F.map_filter(column, lambda k, v: ~F.map_contains_key(names, k))
    return joined.withColumn(column, overlay(renamed, kept)).select(*rows.columns)


def breaking_changes(before: DataFrame, after: DataFrame, forced: bool = False) -> DataFrame:
    """Required properties of one version that the next one lacks."""
    required = before.filter("required").select("model_id", "type", "property")
    lost = required.join(after.select("model_id", "type", "property"), ["model_id", "type", "property"], "left_anti")
    return lost.withColumn("allowed", F.lit(forced))


def exposed_types(types: DataFrame, model_id: str | None = None) -> DataFrame:
    rows = types.filter("exposed")
    return rows if model_id is None else rows.filter(F.col("model_id") == model_id)


def exposed_tenants(types: DataFrame) -> DataFrame:
    return types.filter("exposed").select("model_id").distinct()


def live_properties(properties: DataFrame) -> DataFrame:
    return properties.filter(F.col("deprecated_at").isNull())


def list_types(types: DataFrame, visible: Column | None = None) -> DataFrame:
    """Types a caller may see, with their description and version."""
    rows = types if visible is None else types.filter(visible)
    return rows.select("model_id", "type", "name", "description", "schema_version")


def inferred_edges(properties: DataFrame) -> DataFrame:
    """Edges that REFERENCE properties imply."""
    refers = (F.upper("data_type") == "REFERENCE") & (F.trim(F.coalesce("reference_target", F.lit(""))) != "")
    return properties.filter(refers).select(
        "model_id", F.col("type").alias("source_type"), F.col("reference_target").alias("target_type"),
        F.col("property").alias("via_property"),
    )


def describe_types(types: DataFrame, properties: DataFrame) -> DataFrame:
    """Each type with its properties and the edges that start or end at it."""
    listed = properties.groupBy("model_id", "type").agg(
        F.sort_array(F.collect_list(F.struct("property", "data_type", "required"))).alias("properties")
    )
    edges = inferred_edges(properties)
    whole = F.struct("source_type", "target_type", "via_property")
    touching = edges.select("model_id", F.col("source_type").alias("type"), whole.alias("e")).unionByName(
        edges.select("model_id", F.col("target_type").alias("type"), whole.alias("e"))
    ).distinct()
    grouped = touching.groupBy("model_id", "type").agg(F.sort_array(F.collect_list("e")).alias("edge_types"))
    return types.join(listed, ["model_id", "type"], "left").join(grouped, ["model_id", "type"], "left")
