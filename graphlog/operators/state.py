"""Folding a mutation log into node and edge state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import unquote
from graphlog.model import CREATE, EDGE_PREFIX, OWNED_KEYS, TOMBSTONE

NODE = ["model_id", "node"]
NODE_COLUMNS = [
    "model_id", "node", "type", "created_at", "updated_at", "created_by", "source", "source_id",
    "tombstoned", "tombstoned_at", "seq", "props",
]


def fold_nodes(mutations: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Node state after all mutations: the last write of each property wins.

    Properties are reduced per (node, key) with map-side partial results, then
    gathered per node. ``base`` is earlier state and acts as older writes.
    """
    gone = F.col("operation") == TOMBSTONE
    rows = mutations.select(
        *NODE,
        "seq",
        F.struct(
            "type",
            F.col("event_time").alias("created_at"),
            F.coalesce("source_id", F.lit("")).alias("created_by"),
            F.coalesce("source_system", F.lit("")).alias("source"),
            F.coalesce("source_id", F.lit("")).alias("source_id"),
        ).alias("head"),
        F.col("event_time").alias("updated_at"),
        F.when(gone, F.col("event_time")).alias("tombstoned_at"),
        F.when(~gone, F.col("payload")).alias("payload"),
    )
    if base is not None:
        head = F.struct("type", "created_at", "created_by", "source", "source_id").alias("head")
        rows = rows.unionByName(
            base.select(*NODE, "seq", head, "updated_at", "tombstoned_at", F.col("props").alias("payload"))
        )
    long = rows.select(*NODE, "seq", "head", "updated_at", "tombstoned_at", F.explode_outer("payload").alias("k", "v"))
    per_key = long.groupBy(*NODE, "k").agg(
        F.max_by("v", "seq").alias("v"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.min_by("head", "seq").alias("head"),
        F.max_by("updated_at", "seq").alias("updated_at"),
        F.max("tombstoned_at").alias("tombstoned_at"),
    )
    kept = F.col("k").isNotNull() & ~F.col("k").isin(OWNED_KEYS)
    entry = F.when(kept, F.struct("k", "v"))
    per_node = per_key.groupBy(*NODE).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("props"),
        F.min_by("head", "first").alias("head"),
        F.max_by("updated_at", "last").alias("updated_at"),
        F.max("tombstoned_at").alias("tombstoned_at"),
        F.max("last").alias("seq"),
    )
    return per_node.select(
        *NODE, "head.*", "updated_at", F.col("tombstoned_at").isNotNull().alias("tombstoned"),
        "tombstoned_at", "seq", "props",
    ).select(*NODE_COLUMNS)


def edge_writes(mutations: DataFrame) -> DataFrame:
    """Edge mutations with their endpoints as columns."""
    ends = ["sourceUuid", "targetUuid", "sourceLabel", "targetLabel"]
    rest = F.map_filter("payload", lambda k, v: ~k.isin(*ends, *OWNED_KEYS))
    return mutations.filter(F.col("type").startswith(EDGE_PREFIX)).select(
        "model_id",
        F.col("node").alias("edge"),
        F.substring("type", len(EDGE_PREFIX) + 1, 1 << 30).alias("label"),
        unquote(F.col("payload")["sourceUuid"]).alias("src"),
        unquote(F.col("payload")["targetUuid"]).alias("dst"),
        unquote(F.col("payload")["sourceLabel"]).alias("src_type"),
        unquote(F.col("payload")["targetLabel"]).alias("dst_type"),
        rest.alias("props"),
        "operation", "seq", "event_time", "source_id", "source_system",
    )


def check_edges(writes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``error`` to edge writes.

    ``nodes`` has (model_id, node, type, first_seq). A CREATE needs both ends
    in its own tenant, of the stated type, made before the edge.
    """
    def end(side: str) -> DataFrame:
        return nodes.select(
            "model_id", F.col("node").alias(side), F.col("type").alias(f"{side}_type"),
            F.col("first_seq").alias(f"_{side}_seq"),
        )

    joined = writes.join(end("src"), ["model_id", "src", "src_type"], "left").join(
        end("dst"), ["model_id", "dst", "dst_type"], "left"
    )
    known = (F.col("_src_seq") < F.col("seq")) & (F.col("_dst_seq") < F.col("seq"))
    error = F.when((F.col("operation") == CREATE) & ~F.coalesce(known, F.lit(False)), F.lit("ENDPOINT_NOT_FOUND"))
    error = F.coalesce(error, F.when(F.col("operation") == "UPDATE", F.lit("EDGE_UPDATE_UNSUPPORTED")))
    return joined.withColumn("error", error).select(*writes.columns, "error")


def fold_edges(writes: DataFrame) -> DataFrame:
    """Edge state from accepted edge writes."""
    made = F.col("operation") == CREATE
    gone = F.col("operation") == TOMBSTONE
    head = F.struct(
        "src", "dst", "src_type", "dst_type", "props", F.col("event_time").alias("created_at"),
        F.coalesce("source_id", F.lit("")).alias("created_by"), F.coalesce("source_system", F.lit("")).alias("source"),
    )
    folded = writes.groupBy("model_id", "edge", "label").agg(
        F.min_by(F.when(made, head), F.when(made, F.col("seq"))).alias("head"),
        F.max(F.when(gone, F.col("event_time"))).alias("tombstoned_at"),
    )
    return folded.filter(F.col("head").isNotNull()).select(
        "model_id", "edge", "label", "head.*", F.col("tombstoned_at").isNotNull().alias("tombstoned"), "tombstoned_at"
    )


def hard_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every edge that touches one of them."""
    keys = doomed.select("model_id", "node").distinct()
    left = nodes.join(keys, NODE, "left_anti")
    for side in ("src", "dst"):
        edges = edges.join(keys.withColumnRenamed("node", side), ["model_id", side], "left_anti")
    return left, edges.select(*edges.columns)
