import datetime as dt

from helpers import START, frame, mutation, random_log, replay
from pyspark.sql import functions as F

from graphlog.operators import log
from graphlog.storage import scratch_path
from graphlog.streaming import breaker, feeds, fold
from workload.stream_queries import ROCKSDB


def drain(stream, mode, state, out):
    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_fold_over_batches_with_late_rows(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = random_log(21, 120)
    _, final = replay(rows)
    landing, state, out = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    late = [r for r in rows if r["seq"] % 5 == 0]
    for part in ([r for r in rows if r["seq"] % 5 and r["seq"] < 80], [r for r in rows if r["seq"] % 5 and r["seq"] >= 80], late):
        frame(spark, part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(landing)
        drain(fold.fold_stream(stream), "update", state, out)
    got = {}
    for r in spark.read.option("basePath", out).parquet(out).orderBy("batch").collect():
        got[r.model_id, r.node] = r
    assert {k: v.props for k, v in got.items()} == final
    for k, v in got.items():
        mine = [r for r in rows if (r["model_id"], r["node"]) == k]
        assert v.seq == max(r["seq"] for r in mine) and v.created_at == min(r["event_time"] for r in mine)


def test_breaker_latch_survives_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = [mutation(i + 1, "n", origin_connector_id="c", event_time=START + dt.timedelta(seconds=i // 4)) for i in range(130)]
    landing, state, out = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    for part in (rows[:70], rows[70:125], rows[125:]):
        frame(spark, part).write.mode("append").parquet(landing)
        drain(breaker.breaker_stream(spark.readStream.schema(frame(spark, []).schema).parquet(landing), 3), "append", state, out)
    halted = {r.seq for r in spark.read.parquet(out).filter("halted").collect()}
    trips = log.rate_trips(frame(spark, rows), per_second=3).first()
    assert halted == set(range(trips.trip_seq, 131))


def test_outbox_delivers_each_event_once(spark):
    rows = [mutation(i, f"n{i}", "CREATE", {"a": "1"}) for i in range(6)]
    events = log.histories(frame(spark, rows), ["a"]).withColumn("event_type", log.event_type()).withColumn("event_id", F.concat_ws(":", "model_id", "seq"))
    landing, state, target = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    for part in (events.filter("seq < 4"), events.filter("seq >= 2")):
        part.write.mode("append").parquet(landing)
        feeds.drain_outbox(spark.readStream.schema(events.schema).parquet(landing), target, state).awaitTermination()
    sent = [r.event_id for r in feeds.delivered(spark, target).collect()]
    assert sorted(sent) == [f"t0:{i}" for i in range(6)]


def test_echoes_are_dropped_once_logged(spark):
    old = frame(spark, [mutation(0, "z", "CREATE", origin_connector_id="c", origin_change_id="y")])
    rows = [
        mutation(1, "a", "CREATE", origin_connector_id="c", origin_change_id="x"), mutation(2, "a", "CREATE", origin_connector_id="c", origin_change_id="x"),
        mutation(3, "b", "CREATE", origin_connector_id="c", origin_change_id="y"), mutation(4, "d", "CREATE"), mutation(5, "d", "UPDATE"),
    ]
    landing, state, out = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    frame(spark, rows).write.parquet(landing)
    drain(feeds.suppress_echoes(spark.readStream.schema(old.schema).parquet(landing), old), "append", state, out)
    seqs = {r.seq for r in spark.read.parquet(out).collect()}
    assert {4, 5} <= seqs and len(seqs & {1, 2}) == 1 and 3 not in seqs


def test_changed_files_only(spark):
    landing, state, checkpoint, seen = scratch_path(spark), scratch_path(spark), scratch_path(spark), []
    for docs in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("b", "1")]):
        spark.createDataFrame(docs, "path string, text string").write.mode("append").parquet(landing)
        stream = spark.readStream.schema("path string, text string").parquet(landing)
        feeds.ingest_changed(stream, state, checkpoint, lambda b, i: seen.append(sorted(r.path for r in b.collect()))).awaitTermination()
    assert seen == [["a", "b"], ["b"], ["b"]]
