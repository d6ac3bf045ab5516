"""The streaming forms, run over the given tables until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.storage import materialise, scratch_path
from graphlog.streaming import breaker, feeds, fold
from workload.fixtures import SQL_HISTORY, SQL_MUTATIONS, events, mutations, state_columns, table
from workload.log_queries import _fast
from workload.registry import query

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, df):
    """``df`` written to the shared folder and read back as a stream."""
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(stream, mode="append"):
    """Run to the end; the rows the stream put out, batch by batch."""
    spark = stream.sparkSession
    out = scratch_path(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


@query(
    "stream_fold",
    "WITH"
    + SQL_HISTORY
    + """SELECT model_id, node, max_by(value, seq) AS value, max_by(k, seq) AS k, max(seq) AS seq, bool_or(op = 'TOMBSTONE') AS tombstoned,
       min_by(source_system, seq) AS source FROM hist GROUP BY model_id, node""",
)
def stream_fold(spark, folder):
    states = _run(fold.fold_stream(_stream(spark, mutations(spark, folder))), "update")
    last = states.groupBy("model_id", "node").agg(F.max_by(F.struct("seq", "source", "tombstoned_at", "props"), F.struct("seq", "batch")).alias("s"))
    last = last.select("model_id", "node", "s.*")
    return last.select("model_id", "node", *state_columns(last, "props"), "seq", F.col("tombstoned_at").isNotNull().alias("tombstoned"), "source")


@query(
    "stream_breaker",
    "WITH"
    + SQL_MUTATIONS
    + """, dense AS (SELECT model_id, conn, seq, CAST(floor(epoch_us(event_time) / 1000000 / 6000) AS BIGINT) AS sec FROM mut),
  counted AS (SELECT *, count(*) OVER (PARTITION BY conn, model_id ORDER BY sec RANGE BETWEEN 29 PRECEDING AND 1 PRECEDING)
     + row_number() OVER (PARTITION BY conn, model_id, sec ORDER BY seq) AS in_window FROM dense),
  trips AS (SELECT conn, model_id, min(seq) AS trip_seq FROM counted WHERE in_window > 60 GROUP BY conn, model_id)
  SELECT m.model_id, m.seq, coalesce(m.seq >= t.trip_seq, false) AS halted FROM mut m LEFT JOIN trips t ON m.conn = t.conn AND m.model_id = t.model_id""",
)
def stream_breaker(spark, folder):
    return _run(breaker.breaker_stream(_stream(spark, _fast(spark, folder)), per_second=2)).select("model_id", "seq", "halted")


@query(
    "stream_rate_alerts",
    "WITH"
    + SQL_MUTATIONS
    + """, dense AS (SELECT model_id, conn, CAST(floor(epoch_us(event_time) / 1000000 / 6000) AS BIGINT) AS sec FROM mut),
  slid AS (SELECT model_id, conn, sec - back AS start FROM dense CROSS JOIN range(30) AS r(back))
  SELECT model_id, conn AS origin_connector_id, start, count(*) AS events FROM slid GROUP BY ALL HAVING count(*) > 60""",
)
def stream_rate_alerts(spark, folder):
    alerts = _run(breaker.rate_alerts(_stream(spark, _fast(spark, folder)), per_second=2), "update")
    newest = alerts.groupBy("model_id", "origin_connector_id", F.unix_seconds("window.start").alias("start"))
    return newest.agg(F.max("events").alias("events"))


@query(
    "stream_outbox",
    "WITH" + SQL_HISTORY + "SELECT concat(model_id, ':', seq) AS event_id, node AS aggregateid, event_type AS type, json AS payload FROM evt",
)
def stream_outbox(spark, folder):
    target = scratch_path(spark)
    log = materialise(events(spark, folder))
    feeds.drain_outbox(_stream(spark, log.unionByName(log)), target, scratch_path(spark)).awaitTermination()
    return feeds.delivered(spark, target).select("event_id", "aggregateid", "type", "payload")


@query(
    "stream_echo",
    "WITH"
    + SQL_MUTATIONS
    + """SELECT model_id, conn AS origin_connector_id, change AS origin_change_id, count(DISTINCT change) AS n FROM mut
       WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00' AND (model_id, conn, change) NOT IN
       (SELECT (model_id, conn, change) FROM mut WHERE event_time < TIMESTAMP '2024-01-10 00:00:00') GROUP BY ALL""",
)
def stream_echo(spark, folder):
    m = mutations(spark, folder)
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp")
    log = materialise(m.filter(F.col("event_time") < cut))
    once = _run(feeds.suppress_echoes(_stream(spark, m.filter(F.col("event_time") >= cut)), log, "60 days"))
    return once.groupBy("model_id", "origin_connector_id", "origin_change_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_changed_docs", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def stream_changed_docs(spark, folder):
    out = scratch_path(spark)
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")

    def keep(batch, batch_id):
        batch.select("doc_id", "content_hash").write.mode("append").parquet(out)

    state, checkpoint, landing = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    for _ in range(2):
        docs.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(docs.schema).parquet(landing)
        feeds.ingest_changed(stream, state, checkpoint, keep).awaitTermination()
    return spark.read.parquet(out)
