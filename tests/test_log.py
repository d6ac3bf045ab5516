import datetime as dt
import random
from decimal import Decimal

import pytest
from helpers import START, frame, mutation, random_log, replay
from pyspark.sql import functions as F

from graphlog.operators import chain, log, runs, state


def test_envelope_faults(spark):
    rows = [
        mutation(1, "n", "CREATE", {"name": '"x"'}),
        mutation(2, None, "UPDATE", {"name": '"x"'}),
        mutation(3, "n", "UPDATE", {"bad key": "1"}),
        mutation(4, "n", "UPDATE", {"a": "1"}, confidence=Decimal("1.500")),
        mutation(5, "n", "UPSERT"),
        mutation(6, "e", "CREATE", {"sourceUuid": '"a"'}, type="#edge/KNOWS"),
        mutation(7, "n", "UPDATE", {"a": "1"}, source_system=None),
        mutation(8, "n", "UPDATE", {"a": "1"}, type="1bad"),
    ]
    got = {r.seq: r.error for r in log.check_envelopes(frame(spark, rows)).collect()}
    assert got == {
        1: None, 2: "target node is required", 3: "illegal property key", 4: "confidence must be in [0,1]",
        5: "unknown operation", 6: "edge endpoints are required", 7: "source_system is required", 8: "illegal type",
    }


@pytest.mark.parametrize("chunk", [7, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_histories_equal_replay(spark, seed, chunk):
    rows = random_log(seed)
    events, _ = replay(rows)
    m = frame(spark, rows)
    for found in (log.histories(m, ["a", "b", "c"], chunk=chunk), log.open_histories(m, chunk=chunk)):
        assert {(r.model_id, r.seq): r.payload for r in found.select("model_id", "seq", "payload").collect()} == events


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_deltas_equal_replay(spark, chunk):
    rows = random_log(3)
    events, _ = replay(rows)
    before, want = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        key = (r["model_id"], r["node"])
        post = events[r["model_id"], r["seq"]]
        old = before.get(key, {})
        if r["operation"] == "CREATE":
            want[r["model_id"], r["seq"]] = post
        elif r["operation"] == "TOMBSTONE":
            want[r["model_id"], r["seq"]] = {"_tombstoned": "true"}
        else:
            want[r["model_id"], r["seq"]] = {k: v for k, v in post.items() if old.get(k) != v}
        before[key] = post
    got = {(r.model_id, r.seq): r.delta for r in log.deltas(frame(spark, rows), chunk=chunk).collect()}
    assert got == want


def test_fold_equals_replay_whole_and_in_steps(spark):
    rows = random_log(4)
    _, final = replay(rows)
    m = frame(spark, rows)
    for folded in (state.fold_nodes(m), state.fold_nodes(m.filter("seq > 120"), state.fold_nodes(m.filter("seq <= 120")))):
        got = {(r.model_id, r.node): r for r in folded.collect()}
        assert {k: v.props for k, v in got.items()} == final
        for k, v in got.items():
            mine = [r for r in rows if (r["model_id"], r["node"]) == k]
            assert v.seq == max(r["seq"] for r in mine)
            assert v.source == min(mine, key=lambda r: r["seq"])["source_system"]
            assert v.tombstoned == any(r["operation"] == "TOMBSTONE" for r in mine)
            assert v.created_at == min(r["event_time"] for r in mine)


def test_owned_timestamps_are_stripped(spark):
    rows = [mutation(1, "n", "CREATE", {"_created_at": '"1999"', "name": '"x"'})]
    assert state.fold_nodes(frame(spark, rows)).first().props == {"name": '"x"'}


def test_state_at_follows_create_update_tombstone(spark):
    rows = [
        mutation(1, "n", "CREATE", {"name": '"Alice"'}), mutation(2, "n", "UPDATE", {"name": '"Bob"'}), mutation(3, "n", "TOMBSTONE"),
    ]
    events = log.histories(frame(spark, rows), ["name"])
    seen = [log.state_at(events, F.lit(START + dt.timedelta(minutes=t)), "n", "t0").collect() for t in range(4)]
    assert seen[0] == []
    assert [s[0].state.get("name") for s in seen[1:]] == ['"Alice"', '"Bob"', '"Bob"']
    assert seen[3][0].state["_tombstoned"] == "true"


@pytest.mark.parametrize("parts", [1, 9])
def test_as_of_join_equals_scan(spark, parts):
    rows = random_log(5, 200)
    rnd = random.Random(5)
    probes = [(f"t{rnd.randrange(2)}", f"n{rnd.randrange(7)}", START + dt.timedelta(seconds=rnd.randrange(-60, 13000))) for _ in range(150)]
    probes += [("t0", "n0", r["event_time"]) for r in rows if r["node"] == "n0"]
    asked = spark.createDataFrame(probes, "model_id string, node string, as_of timestamp").distinct()
    events = log.histories(frame(spark, rows), ["a", "b", "c"])
    got = {(r.model_id, r.node, r.as_of): r.seq for r in log.state_as_of(events, asked, parts).collect()}
    want = {
        p: max((r["seq"] for r in rows if (r["model_id"], r["node"]) == p[:2] and r["event_time"] <= p[2]), default=None) for p in set(probes)
    }
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_dense_per_tenant(spark, parts):
    rows = [(f"t{0 if i % 3 else i % 4}", i % 11, i) for i in range(400)]
    df = spark.createDataFrame(rows, "model_id string, ts int, id int")
    start = spark.createDataFrame([("t0", 100)], "model_id string, last bigint")
    got = runs.numbered(df, "model_id", ["ts", "id"], start=start, parts=parts).collect()
    for tenant in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.model_id == tenant), key=lambda r: (r.ts, r.id))
        first = 101 if tenant == "t0" else 1
        assert [r.seq for r in mine] == list(range(first, first + len(mine)))


@pytest.mark.parametrize("kind,model", [("min", min), ("max", max), ("sum", sum), ("last", lambda v: v[-1]), ("first", lambda v: v[0])])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_over_split_groups(spark, kind, model, inclusive):
    rnd = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rnd.randrange(50) if rnd.random() < 0.7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, seq bigint, v int")
    got = {r.seq: r.out for r in runs.running(df, ["g"], "seq", {"out": (kind, F.col("v"))}, inclusive, chunk=8).collect()}
    for g, seq, _ in rows:
        seen = [v for h, s, v in rows if h == g and v is not None and (s < seq or inclusive and s == seq)]
        assert got[seq] == (model(seen) if seen else None)


def test_echoes(spark):
    rows = [
        mutation(1, "a", "CREATE", origin_connector_id="c", origin_change_id="x"),
        mutation(2, "b", "CREATE", origin_connector_id="c", origin_change_id="x"),
        mutation(3, "c", "CREATE", origin_connector_id="c", origin_change_id="y"),
        mutation(4, "d", "CREATE", model="t1", origin_connector_id="c", origin_change_id="x"),
        mutation(5, "e", "CREATE", origin_connector_id="c"),
        mutation(6, "f", "CREATE", origin_connector_id="c"),
    ]
    m = frame(spark, rows)
    assert {r.seq for r in log.mark_echoes(m).filter("echo").collect()} == {2}
    old = frame(spark, [mutation(0, "z", "CREATE", origin_connector_id="c", origin_change_id="y")])
    assert {r.seq for r in log.mark_echoes(m, old).filter("echo").collect()} == {2, 3}


def test_breaker_trips_latches_and_exempts(spark):
    def burst(n, conn, start=0, seq0=0, per=100):
        return [mutation(seq0 + i + 1, "n", origin_connector_id=conn, event_time=START + dt.timedelta(seconds=start + i // per)) for i in range(n)]

    rows = burst(301, "c1") + burst(300, "c2", seq0=1000) + burst(400, None, seq0=2000) + burst(2, "c1", 4000, 3000)
    rows += burst(301, "c3", start=3590, seq0=4000, per=15)
    m = frame(spark, rows)
    trips = {r.origin_connector_id: r for r in log.rate_trips(m, per_second=10).collect()}
    assert set(trips) == {"c1", "c3"}
    assert trips["c1"].trip_seq == 301 and trips["c1"].events_in_window == 301
    assert trips["c3"].trip_seq == 4301
    halted = {r.seq for r in log.mark_halted(m, log.rate_trips(m, per_second=10)).filter("halted").collect()}
    assert halted == {301, 3001, 3002, 4301}
    limits = spark.createDataFrame([("c1", "t0", 20)], "origin_connector_id string, model_id string, threshold int")
    assert {r.origin_connector_id for r in log.rate_trips(m, limits, per_second=10).collect()} == {"c3"}
    grace = F.lit(START + dt.timedelta(hours=3))
    assert log.rate_trips(m, per_second=10, grace_until=grace).count() == 0


@pytest.mark.parametrize("chunk", [9, 1 << 20])
def test_chain_links_and_breaks(spark, chunk):
    rows = random_log(6, 120)
    events = log.histories(frame(spark, rows), ["a", "b", "c"]).withColumn("event_type", log.event_type())
    built = chain.build_chain(events, chunk=chunk)
    texts = {(r.model_id, r.seq): r.j for r in events.select("model_id", "seq", log.canonical_json(F.col("payload")).alias("j")).collect()}
    import hashlib

    last = {}
    for key in sorted(texts):
        tip = last.get(key[0], chain.genesis())
        last[key[0]] = hashlib.sha256((tip + texts[key]).encode()).hexdigest()
        texts[key] = last[key[0]]
    assert {(r.model_id, r.seq): r.prev_hash for r in built.collect()} == texts

    stored = events.join(built, ["model_id", "seq"])
    assert {(r.valid, r.events_checked) for r in chain.verify_chain(stored, chunk=chunk).collect()} == {
        (True, sum(r["model_id"] == t for r in rows)) for t in ("t0", "t1")
    }
    spot = sorted(r["seq"] for r in rows if r["model_id"] == "t0")[40]
    altered = F.when((F.col("seq") == spot) & (F.col("model_id") == "t0"), F.create_map(F.lit("a"), F.lit("9"))).otherwise(F.col("payload"))
    got = {r.model_id: r for r in chain.verify_chain(stored.withColumn("payload", altered), chunk=chunk).collect()}
    assert not got["t0"].valid and got["t0"].broken_seq == spot and got["t0"].events_checked == 40
    assert got["t1"].valid


def test_chain_continues_from_heads_and_is_opt_in(spark):
    rows = random_log(7, 80)
    events = log.histories(frame(spark, rows), ["a", "b", "c"]).withColumn("event_type", log.event_type())
    whole = {(r.model_id, r.seq): r.prev_hash for r in chain.build_chain(events).collect()}
    first = chain.build_chain(events.filter("seq <= 50"))
    heads = first.groupBy("model_id").agg(F.max_by("prev_hash", "seq").alias("prev_hash"))
    rest = chain.build_chain(events.filter("seq > 50"), heads=heads)
    assert {(r.model_id, r.seq): r.prev_hash for r in first.unionByName(rest).collect()} == whole
    tenants = spark.createDataFrame([("t0", True), ("t1", False)], "model_id string, hash_chain boolean")
    assert {r.model_id for r in chain.build_chain(events, tenants).collect()} == {"t0"}


def test_a_missing_hash_is_a_break_and_a_chain_may_be_off(spark):
    rows = random_log(9, 60)
    events = log.histories(frame(spark, rows), ["a", "b", "c"]).withColumn("event_type", log.event_type())
    stored = events.join(chain.build_chain(events), ["model_id", "seq"])
    tail = max(r["seq"] for r in rows if r["model_id"] == "t0")
    cut = (F.col("model_id") == "t0") & (F.col("seq") == tail)
    stripped = stored.withColumn("prev_hash", F.when(~cut, F.col("prev_hash")))
    got = {r.model_id: r for r in chain.verify_chain(stripped).collect()}
    assert not got["t0"].valid and got["t0"].broken_seq == tail and got["t0"].actual is None and got["t1"].valid
    tenants = spark.createDataFrame([("t0", False), ("t1", True)], "model_id string, hash_chain boolean")
    assert [r.model_id for r in chain.verify_chain(stripped, tenants=tenants).collect()] == ["t1"]


def _numbered_log(spark, seed, size):
    rows = random_log(seed, size)
    events = log.histories(frame(spark, rows), ["a", "b", "c"]).withColumn("event_type", log.event_type())
    return rows, events.withColumn("event_id", F.concat_ws(":", "model_id", "seq"))


def test_compaction_keeps_state_and_counts(spark):
    rows, events = _numbered_log(spark, 8, 150)
    states, final = replay(rows)
    compacted, counts = chain.compact(events, F.lit(START + dt.timedelta(days=2)))
    got = compacted.collect()
    assert {r.event_type for r in got} == {"SNAPSHOT"} and {r.confidence for r in got} == {Decimal("1.000")}
    assert {(r.model_id, r.seq): r.payload for r in got}.items() <= states.items()
    assert {(r.model_id, r.node) for r in got} == set(final)
    assert sum(r.deleted for r in counts.collect()) == 150 and sum(r.written for r in counts.collect()) == len(final)
    assert len({(r.model_id, r.seq) for r in got}) == len(got)


def test_time_travel_over_a_compacted_log(spark):
    rows, events = _numbered_log(spark, 10, 160)
    boundary = START + dt.timedelta(minutes=80)
    compacted, _ = chain.compact(events, F.lit(boundary))
    for minutes in (80, 81, 120, 500):
        at = F.lit(START + dt.timedelta(minutes=minutes))
        whole, short = ({(r.model_id, r.node): (r.state, r.tombstoned) for r in log.state_at(e, at).collect()} for e in (events, compacted))
        assert whole == short and any(gone for _, gone in whole.values())


def test_the_latest_state_is_the_fold(spark):
    rows, events = _numbered_log(spark, 11, 200)
    folded = {(r.model_id, r.node): (r.props, r.tombstoned, r.seq) for r in state.fold_nodes(frame(spark, rows)).collect()}
    found = log.state_at(events, F.lit(START + dt.timedelta(days=9))).collect()
    assert {(r.model_id, r.node): ({k: v for k, v in r.state.items() if k != "_tombstoned"}, r.tombstoned, r.seq) for r in found} == folded


def test_a_tombstone_stays_through_later_updates(spark):
    rows = [mutation(1, "n", "CREATE", {"a": "1"}), mutation(2, "n", "TOMBSTONE", {"a": "9"}), mutation(3, "n", "UPDATE", {"b": "2", "_created_at": "0"})]
    events = log.histories(frame(spark, rows), ["a"])
    last = log.state_at(events, F.lit(START + dt.timedelta(days=1))).first()
    assert last.tombstoned and last.state == {"a": "1", "b": "2", "_tombstoned": "true"}
    probes = spark.createDataFrame([("t0", "n", START + dt.timedelta(minutes=m)) for m in (1, 2, 3)], "model_id string, node string, as_of timestamp")
    assert [r.tombstoned for r in sorted(log.state_as_of(events, probes).collect(), key=lambda r: r.as_of)] == [False, True, True]
    assert log.deltas(frame(spark, rows)).filter("seq = 3").first().delta == {"b": "2"}


def test_retention_keeps_snapshots_and_unlimited_tenants(spark):
    rows = [mutation(i, "n", model=m, event_time=START + dt.timedelta(days=i)) for i in range(10) for m in ("t0", "t1", "t2")]
    events = frame(spark, rows).withColumn("event_type", F.when(F.col("seq") == 2, "SNAPSHOT").otherwise("UPDATE_NODE"))
    config = spark.createDataFrame(
        [("t0", 5, None), ("t1", 5, START + dt.timedelta(days=1)), ("t2", None, None)],
        "model_id string, retention_days int, snapshot_boundary timestamp",
    )
    kept = log.retain(events, config, F.lit(START + dt.timedelta(days=10)))
    got = {t: sorted(r.seq for r in kept.filter(F.col("model_id") == t).collect()) for t in ("t0", "t1", "t2")}
    assert got == {"t0": [2, 5, 6, 7, 8, 9], "t1": [0, 1, 2, 5, 6, 7, 8, 9], "t2": list(range(10))}
    deleted = log.purge_counts(events, config, F.lit(START + dt.timedelta(days=10)))
    assert {r.model_id: r.deleted for r in deleted.collect()} == {"t0": 4, "t1": 2}


def test_edges_need_ends_in_their_tenant_and_hard_delete_detaches(spark):
    ends = {"sourceUuid": '"a"', "targetUuid": '"b"', "sourceLabel": '"person"', "targetLabel": '"person"'}
    nodes = [mutation(1, "a", "CREATE"), mutation(2, "b", "CREATE"), mutation(3, "a", "CREATE", model="t1")]
    edges = [
        mutation(4, "e1", "CREATE", {**ends, "since": "2020"}, type="#edge/KNOWS"),
        mutation(5, "e2", "CREATE", ends, model="t1", type="#edge/KNOWS"),
        mutation(6, "e1", "TOMBSTONE", ends, type="#edge/KNOWS"),
    ]
    born = frame(spark, nodes).select("model_id", "node", "type", F.col("seq").alias("first_seq"))
    checked = state.check_edges(state.edge_writes(frame(spark, edges)), born)
    assert {r.seq: r.error for r in checked.collect()} == {4: None, 5: "ENDPOINT_NOT_FOUND", 6: None}
    folded = state.fold_edges(checked.filter("error IS NULL"))
    row = folded.first()
    assert (row.src, row.dst, row.label, row.tombstoned, row.props) == ("a", "b", "KNOWS", True, {"since": "2020"})
    left, linked = state.hard_delete(state.fold_nodes(frame(spark, nodes)), folded, spark.createDataFrame([("t0", "b")], "model_id string, node string"))
    assert {(r.model_id, r.node) for r in left.collect()} == {("t0", "a"), ("t1", "a")} and linked.count() == 0


def test_queries_that_read_the_log_twice_work_it_out_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from workload import stream_queries

    folder = "/root/testdata/sf0.001"
    files = entry.queries()["chain_verify"](spark, folder).inputFiles()
    assert files and not [f for f in files if f.endswith("/events.parquet")]
    seen, stream = [], stream_queries._stream
    monkeypatch.setattr(stream_queries, "_stream", lambda s, df: seen.extend(df.inputFiles()) or stream(s, df))
    entry.queries()["stream_outbox"](spark, folder)
    assert seen and not [f for f in seen if f.endswith("/events.parquet")]
