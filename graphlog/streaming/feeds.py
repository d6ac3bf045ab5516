"""Outgoing messages, echo suppression and file ingest on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlog.operators.log import ORIGIN, outbox
from graphlog.sources.documents import changed_documents
from graphlog.storage import file_system


def _empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored at ``path`` so far; nothing before the first batch."""
    files, where = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(where) else spark.createDataFrame([], schema)


def drain_outbox(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Deliver each event's message once to a Parquet table at ``target``.

    A batch replaces its own folder, so a replayed batch delivers nothing
    twice, and messages already delivered by earlier batches are left out by
    event id. The checkpoint takes the place of a delivery status.
    """
    ledger = f"{target}/batch"

    def deliver(batch: DataFrame, batch_id: int) -> None:
        messages = outbox(batch).dropDuplicates(["event_id"])
        sent = _empty(batch.sparkSession, ledger, "event_id string, batch_id bigint").filter(F.col("batch_id") != batch_id)
        fresh = messages.join(sent.select("event_id"), "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", f"{target}/batch").parquet(f"{target}/batch").drop("batch_id")


def suppress_echoes(mutations: DataFrame, log: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop repeats of a connector's change: against recent state, bounded by
    the watermark, and against the whole log by an anti-join.
    """
    named = F.col("origin_connector_id").isNotNull() & F.col("origin_change_id").isNotNull()
    known = log.filter(named).select(*ORIGIN).distinct()
    fresh = mutations.join(known, ORIGIN, "left_anti")
    once = F.when(named, F.lit("")).otherwise(F.concat_ws(":", "model_id", "seq"))
    keyed = fresh.withColumn("_once", once).withWatermark("event_time", horizon)
    return keyed.dropDuplicatesWithinWatermark([*ORIGIN, "_once"]).drop("_once")


def ingest_changed(documents: DataFrame, state: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Pass on new and changed documents of a file stream.

    ``documents`` has path and text. Hashes are kept per batch at ``state``;
    the newest hash of a path is what the next batch is compared with.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        stored = _empty(batch.sparkSession, state, "path string, content_hash string, batch_id bigint")
        earlier = stored.filter(F.col("batch_id") < batch_id)
        latest = earlier.groupBy("path").agg(F.max_by("content_hash", "batch_id").alias("content_hash"))
        fresh = changed_documents(batch, latest)
        fresh.select("path", "content_hash").write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        sink(fresh, batch_id)

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
