"""Tamper-evident hash chain over a tenant's events, and log compaction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlog.functions.literals import canonical_json, overlay
from graphlog.model import CHUNK_ROWS, SNAPSHOT, TOMBSTONE
from graphlog.operators.log import TOMBSTONED
from graphlog.operators.runs import running
from graphlog.storage import materialise, scratch_path

SENTINEL = "GENESIS"


def genesis(sentinel: str = SENTINEL) -> str:
    return hashlib.sha256(sentinel.encode()).hexdigest()


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain rows sorted by tenant and order; only the last hash is held."""
    tenant, last = None, ""
    for batch in batches:
        hashes = []
        for model_id, head, text in zip(batch["model_id"], batch["_head"], batch["_text"]):
            if model_id != tenant:
                tenant, last = model_id, head
            last = hashlib.sha256((last + text).encode()).hexdigest()
            hashes.append(last)
        yield pd.DataFrame({"model_id": batch["model_id"], "seq": batch["seq"], "prev_hash": hashes})


def build_chain(
    events: DataFrame,
    tenants: DataFrame | None = None,
    heads: DataFrame | None = None,
    sentinel: str = SENTINEL,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """(model_id, seq, prev_hash): each hash covers the one before it.

    A chain is sequential by definition. Tenants run side by side; a long
    tenant is walked ``chunk`` sequence numbers at a time, each step taking
    the last hash of the step before, so that no task holds more than one
    step of a tenant; steps without rows cost nothing. ``heads`` (model_id, prev_hash) continues stored chains,
    which makes the usual job as long as the new events only.
    """
    spark = events.sparkSession
    rows = events.filter(F.col("event_type") != SNAPSHOT)
    if tenants is not None:
        rows = rows.join(tenants.filter("hash_chain").select("model_id"), "model_id", "left_semi")
    rows = rows.select(
        "model_id", "seq", canonical_json(F.col("payload")).alias("_text"),
        F.floor(F.col("seq") / chunk).cast("long").alias("_step"),
    )
    steps = materialise(rows, "_step")
    held = sorted(r[0] for r in steps.select("_step").distinct().collect())
    schema = T.StructType(
        [T.StructField("model_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType())]
    )
    if not held:
        return spark.createDataFrame([], schema)
    known = heads.select("model_id", "prev_hash") if heads is not None else None
    out = scratch_path(spark)
    for step in held:
        part = steps.filter(F.col("_step") == step)
        start = F.lit(genesis(sentinel))
        if known is not None:
            part = part.join(known.withColumnRenamed("prev_hash", "_known"), "model_id", "left")
            start = F.coalesce("_known", start)
        part = part.select("model_id", "seq", "_text", start.alias("_head"))
        sorted_part = part.repartition("model_id").sortWithinPartitions("model_id", "seq")
        sorted_part.mapInPandas(_link, schema).write.parquet(f"{out}/step={step}")
        done = spark.read.schema(schema).parquet(f"{out}/step={step}")
        tips = done.groupBy("model_id").agg(F.max_by("prev_hash", "seq").alias("_tip"))
        if known is None:
            known = tips.withColumnRenamed("_tip", "prev_hash")
        else:
            known = known.join(tips, "model_id", "full_outer").select(
                "model_id", F.coalesce("_tip", "prev_hash").alias("prev_hash")
            )
        if step < held[-1]:
            known = materialise(known)
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def verify_chain(
    events: DataFrame, sentinel: str = SENTINEL, chunk: int = CHUNK_ROWS, tenants: DataFrame | None = None
) -> DataFrame:
    """Per tenant: valid, events checked before a break, and the first break.

    Each stored hash is recomputed from the stored one before it, so all rows
    are checked at once. A missing hash is a break. ``tenants`` (model_id,
    hash_chain) leaves out those whose chain is off.
    """
    rows = events.filter(F.col("event_type") != SNAPSHOT)
    if tenants is not None:
        rows = rows.join(tenants.filter("hash_chain").select("model_id"), "model_id", "left_semi")
    rows = rows.select("model_id", "seq", "prev_hash", canonical_json(F.col("payload")).alias("_text"))
    linked = running(rows, ["model_id"], "seq", {"_before": ("last", F.col("prev_hash"))}, inclusive=False, chunk=chunk)
    expected = F.sha2(F.concat(F.coalesce("_before", F.lit(genesis(sentinel))), F.col("_text")), 256)
    checked = linked.withColumn("_expected", expected)
    bad = ~F.col("_expected").eqNullSafe(F.col("prev_hash"))
    breaks = checked.filter(bad).groupBy("model_id").agg(
        F.min_by(F.struct(F.col("seq").alias("broken_seq"), F.col("_expected").alias("expected"),
                          F.col("prev_hash").alias("actual")), "seq").alias("_b")
    ).select("model_id", "_b.*")
    fine = F.col("broken_seq").isNull() | (F.col("seq") < F.col("broken_seq"))
    counted = rows.select("model_id", "seq").join(breaks, "model_id", "left").groupBy("model_id").agg(
        F.count_if(fine).alias("events_checked")
    )
    return counted.join(breaks, "model_id", "left").select(
        "model_id", F.col("broken_seq").isNull().alias("valid"), "events_checked", "broken_seq", "expected", "actual"
    )


def latest_per_entity(events: DataFrame) -> DataFrame:
    """Last event of each node or edge, its tombstone mark included."""
    rows = events.filter(F.col("event_type") != SNAPSHOT)
    rows = rows.withColumn("_entity", F.coalesce("node", "edge") if "edge" in events.columns else F.col("node"))
    last = F.max_by(F.struct("node", *(["edge"] if "edge" in events.columns else []), "type", "payload", "seq"), "seq")
    found = rows.groupBy("model_id", "_entity").agg(last.alias("_l"), F.bool_or(F.col("operation") == TOMBSTONE).alias("_gone"))
    found = found.select("model_id", "_entity", "_l.*", "_gone")
    mark = F.create_map(F.lit(TOMBSTONED), F.lit("true"))
    return found.withColumn("payload", F.when(F.col("_gone"), overlay(F.col("payload"), mark)).otherwise(F.col("payload"))).drop("_gone")


def compact(events: DataFrame, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """(new log, counts): one SNAPSHOT event per entity replaces its events before ``boundary``.

    A snapshot is stamped ``boundary`` and takes the number of the last event
    it replaces, so it stands below every event that is kept and the state at
    any instant from the boundary on is what it was.
    """
    old = (F.col("event_type") != SNAPSHOT) & (F.col("event_time") < boundary)
    entities = latest_per_entity(events.filter(old))
    columns = events.columns
    values = {
        "event_time": boundary,
        "event_type": F.lit(SNAPSHOT),
        "operation": F.lit(SNAPSHOT),
        "source_type": F.lit("SYSTEM"),
        "source_id": F.lit("compaction"),
        "source_system": F.lit("compaction"),
        "confidence": F.lit(1).cast("decimal(4,3)"),
        "event_id": F.concat_ws(":", F.lit("snapshot"), "model_id", "_entity"),
    }
    made = ["model_id", "node", "edge", "type", "payload", "seq"]
    snapshot = entities.select(
        *[
            F.col(c) if c in made
            else values[c].cast(events.schema[c].dataType).alias(c) if c in values
            else F.lit(None).cast(events.schema[c].dataType).alias(c)
            for c in columns
        ]
    )
    log = events.filter(~old).unionByName(snapshot)
    counts = entities.groupBy("model_id").agg(F.count(F.lit(1)).alias("written")).join(
        events.filter(old).groupBy("model_id").agg(F.count(F.lit(1)).alias("deleted")), "model_id", "left"
    ).select("model_id", "written", F.coalesce("deleted", F.lit(0)).alias("deleted"))
    return log, counts


def newest_snapshots(events: DataFrame) -> DataFrame:
    """Drop snapshots that a later compaction replaced."""
    entity = F.coalesce("node", "edge") if "edge" in events.columns else F.col("node")
    snaps = events.filter(F.col("event_type") == SNAPSHOT).withColumn("_entity", entity)
    best = snaps.groupBy("model_id", "_entity").agg(F.max("seq").alias("seq"))
    kept = snaps.join(best, ["model_id", "_entity", "seq"], "left_semi").select(*events.columns)
    return events.filter(F.col("event_type") != SNAPSHOT).unionByName(kept)
