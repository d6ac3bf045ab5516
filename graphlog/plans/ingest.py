"""Connector runs: landed documents to mutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.operators import resolve, review
from graphlog.sources import documents, rows
from graphlog.storage import materialise


@dataclass(frozen=True)
class Mapping:
    root: str
    type: str
    source_system: str
    identity: list[str]
    fields: list[rows.Field]


def ingest_rows(raw: DataFrame, mapping: Mapping, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mutations, dead letters) of landed JSON documents.

    ``raw`` has ``value``, ``model_id``, ``connector_id`` and ``change_id``
    (of the document); the row's position completes the change id.
    """
    mapped = rows.map_rows(rows.explode_rows(raw, mapping.root), mapping.fields)
    good, bad = rows.split_errors(mapped)
    typed = good.select(
        "model_id", "connector_id", F.concat_ws(":", "change_id", "position").alias("change_id"),
        F.lit(mapping.type).alias("type"), F.lit(mapping.source_system).alias("source_system"), "properties", "source_hash",
    )
    return rows.to_mutations(rows.classify(typed, existing, mapping.identity)), bad


def ingest_extractions(responses: DataFrame, nodes: DataFrame, threshold: float, created_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mutations, review queue rows, dead letters) of model responses.

    ``responses`` has ``response``, ``model_id``, ``connector_id``,
    ``source_document_id`` and ``source_chunk_range``.
    """
    found, bad = documents.parse_responses(responses)
    found = documents.extracted_properties(found)
    change = documents.change_id(F.col("source_document_id"), F.col("type"), F.col("name"))
    candidates = found.withColumn("change_id", change).withColumn(
        "candidate_id", F.concat_ws("|", "source_document_id", "source_chunk_range", "change_id")
    ).withColumn("source_system", F.concat(F.lit("unstructured-text:"), F.col("connector_id")))
    candidates = materialise(candidates)  # parsed once; every tier and both results read them
    resolved = resolve.resolve(candidates, nodes, threshold=threshold)
    mutations = rows.to_mutations(review.merge_matches(candidates, resolved))
    return mutations, review.enqueue(candidates, resolved, created_at), bad
