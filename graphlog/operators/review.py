"""The review queue for entities no tier could match, and its decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.model import CREATE, UPDATE
from graphlog.operators.read import bounded


def enqueue(candidates: DataFrame, resolved: DataFrame, created_at: Column) -> DataFrame:
    """Queue rows for the candidates that need review."""
    waiting = resolved.filter(F.col("outcome") == "NEEDS_REVIEW")
    waiting = waiting.select("candidate_id", F.col("tier").alias("resolution_tier"),
                             F.col("score").cast("decimal(6,5)").alias("resolution_score"))
    none = F.lit(None).cast("string")
    return candidates.join(waiting, "candidate_id").withColumn("created_at", created_at).withColumn("decision", none)


def pending(queue: DataFrame, model_id: str, connector: str | None = None, node_type: str | None = None,
            since: Column | None = None, limit: int = 50, most: int = 200, after: tuple | None = None) -> DataFrame:
    """Undecided rows of a tenant, oldest first, at most ``most`` at once.

    ``after`` is the (created_at, candidate_id) of the last row of the page before.
    """
    where = (F.col("model_id") == model_id) & F.col("decision").isNull()
    if connector is not None:
        where = where & (F.col("connector_id") == connector)
    if node_type is not None:
        where = where & (F.col("type") == node_type)
    if since is not None:
        where = where & (F.col("created_at") >= since)
    if after is not None:
        later = F.col("created_at") > F.lit(after[0])
        where = where & (later | ((F.col("created_at") == F.lit(after[0])) & (F.col("candidate_id") > F.lit(after[1]))))
    return queue.filter(where).orderBy("created_at", "candidate_id").limit(bounded(limit, 50, most))


def decide(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated queue, mutations): only undecided rows take a decision.

    ACCEPTED makes a new node, OVERRIDDEN updates the named one, REJECTED
    changes nothing. ``decisions`` has (model_id, candidate_id, decision,
    target).
    """
    verdict = decisions.select("model_id", "candidate_id", F.col("decision").alias("_d"), F.col("target").alias("_t"))
    joined = queue.join(verdict, ["model_id", "candidate_id"], "left")
    takes = F.col("decision").isNull() & F.col("_d").isNotNull()
    updated = joined.withColumn("decision", F.coalesce("decision", "_d")).drop("_d", "_t").select(*queue.columns)
    acted = joined.filter(takes & F.col("_d").isin("ACCEPTED", "OVERRIDDEN"))
    over = F.col("_d") == "OVERRIDDEN"
    mutations = acted.select(
        "model_id",
        "candidate_id",
        F.when(over, F.lit(UPDATE)).otherwise(F.lit(CREATE)).alias("operation"),
        "type",
        F.when(over, F.col("_t")).alias("node"),
        "payload",
        F.lit("UNSTRUCTURED").alias("source_type"),
        F.col("source_document_id").alias("source_id"),
        F.lit("extraction-review").alias("source_system"),
        F.lit(1).cast("decimal(4,3)").alias("confidence"),
        "source_document_id",
        "source_chunk_range",
    )
    return updated, mutations


def merge_matches(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """Candidates that matched, aimed at the node they matched."""
    hits = resolved.filter(F.col("outcome") == "MATCH").select("candidate_id", F.col("node").alias("_match"))
    joined = candidates.join(hits, "candidate_id")
    target = F.coalesce("_match", "node") if "node" in candidates.columns else F.col("_match")
    return joined.withColumn("node", target).drop("_match")
