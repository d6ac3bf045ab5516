"""Log and topic tables on shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.functions.literals import canonical_json
from graphlog.storage import file_system


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """The event log as Parquet, one partition per month of event time.

    Rows are gathered by month, and adaptive execution splits a month into as
    many tasks as its size needs.
    """
    rows = events.withColumn("event_month", F.date_format("event_time", "yyyy-MM"))
    rows.hint("rebalance", F.col("event_month")).write.mode(mode).partitionBy("event_month").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def topic_rows(events: DataFrame, prefix: str = "graph") -> DataFrame:
    """One message per event: topic, key, value, and its type as a header."""
    header = F.struct(F.lit("eventType").alias("key"), F.encode("event_type", "UTF-8").alias("value"))
    return events.select(
        F.concat_ws(".", F.lit(prefix), "model_id", "type").alias("topic"),
        F.col("node").alias("key"),
        canonical_json(F.col("payload")).alias("value"),
        F.array(header).alias("headers"),
    )


def write_topics(messages: DataFrame, target: str, options: dict[str, str] | None = None) -> None:
    """To Kafka when ``options`` name its servers, else Parquet by topic.

    The Kafka form needs the Spark Kafka package on the class path.
    """
    if options:
        messages.write.format("kafka").options(**options).option("includeHeaders", "true").save()
        return
    messages.hint("rebalance", F.col("topic")).write.mode("append").partitionBy("topic").parquet(target)


def event_span(start: Column, end: Column) -> Column:
    """Month bounds for a time span, so that other months are not listed."""
    month = F.col("event_month")
    inside = (F.col("event_time") >= start) & (F.col("event_time") < end)
    return (month >= F.date_format(start, "yyyy-MM")) & (month <= F.date_format(end, "yyyy-MM")) & inside


def publish(log: DataFrame, root: str) -> int:
    """Write a whole log as the next version below ``root``.

    Compaction and retention replace a log. Readers keep the version they
    opened; a version counts only once its job has committed, so a failed or
    half-written one is never read. Returns the version.
    """
    version = max(_versions(log.sparkSession, root, committed=False), default=0) + 1
    log.write.parquet(f"{root}/version={version}")
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version."""
    return spark.read.parquet(f"{root}/version={max(_versions(spark, root, committed=True))}")


def _versions(spark: SparkSession, root: str, committed: bool) -> list[int]:
    files, path = file_system(spark, root)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return [v for v in found if not committed or files.exists(file_system(spark, f"{root}/version={v}/_SUCCESS")[1])]
