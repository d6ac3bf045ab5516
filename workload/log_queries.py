"""Mutation log: envelopes, order, deltas, history, time travel, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.functions.literals import canonical_json
from graphlog.operators import chain, log, runs, state
from graphlog.storage import materialise
from workload.fixtures import (
    SQL_EDGES,
    SQL_HISTORY,
    SQL_MUTATIONS,
    SQL_NODES,
    STATE_KEYS,
    at,
    edges,
    events,
    mutations,
    nodes,
    state_columns,
    table,
)
from workload.registry import query


def _micros(name: str):
    return F.unix_micros(name).alias(name)


@query(
    "envelope_check",
    """SELECT event_id AS seq,
       CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'unknown operation'
            WHEN value > 300 THEN 'confidence must be in [0,1]'
            WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'illegal property key'
            WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'target node is required' END AS error
       FROM events""",
)
def envelope_check(spark, folder):
    ev = table(spark, folder, "events")
    odd = (F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)
    key = F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), F.lit("bad key")).otherwise(F.lit("value"))
    m = ev.select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.col("event_id").alias("seq"),
        F.when(odd, "MERGE").otherwise("UPDATE").alias("operation"),
        F.lit("user").alias("type"),
        F.when(~((F.col("event_type") == "click") & (F.col("event_id") % 7 == 0)), F.concat(F.lit("user:"), F.col("user_id"))).alias("node"),
        F.create_map(key, F.col("value").cast("string")).alias("payload"),
        F.lit("STRUCTURED").alias("source_type"),
        F.lit("s").alias("source_id"),
        F.col("event_type").alias("source_system"),
        F.when(F.col("value") > 300, 1.5).otherwise(0.5).cast("decimal(4,3)").alias("confidence"),
    )
    return log.check_envelopes(m).select("seq", "error")


@query(
    "assign_sequence",
    """SELECT event_id, concat('t', user_id % 3) AS model_id,
       row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS seq FROM events""",
)
def assign_sequence(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", "ts", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("model_id")
    )
    return runs.numbered(rows, "model_id", ["ts", "event_id"]).select("event_id", "model_id", "seq")


@query(
    "fold_nodes",
    "WITH"
    + SQL_HISTORY
    + """SELECT model_id, node, max_by(value, seq) AS value, max_by(k, seq) AS k, max(seq) AS seq,
       bool_or(op = 'TOMBSTONE') AS tombstoned, min_by(source_system, seq) AS source,
       epoch_us(min(event_time)) AS created_at, epoch_us(max_by(event_time, seq)) AS updated_at
       FROM hist GROUP BY model_id, node""",
)
def fold_nodes(spark, folder):
    folded = state.fold_nodes(mutations(spark, folder))
    return folded.select(
        "model_id", "node", *state_columns(folded, "props"), "seq", "tombstoned", "source", _micros("created_at"), _micros("updated_at")
    )


@query(
    "fold_incremental",
    "WITH"
    + SQL_HISTORY
    + """SELECT model_id, node, max_by(value, seq) AS value, max_by(k, seq) AS k, max(seq) AS seq,
       bool_or(op = 'TOMBSTONE') AS tombstoned, min_by(source_system, seq) AS source FROM hist GROUP BY model_id, node""",
)
def fold_incremental(spark, folder):
    m = mutations(spark, folder)
    cut = at("2024-01-15 00:00:00")
    base = state.fold_nodes(m.filter(F.col("event_time") < cut))
    folded = state.fold_nodes(m.filter(F.col("event_time") >= cut), base)
    return folded.select("model_id", "node", *state_columns(folded, "props"), "seq", "tombstoned", "source")


@query(
    "mutation_delta",
    "WITH"
    + SQL_MUTATIONS
    + """, keyed AS (
       SELECT model_id, node, seq, op, 'k' AS key, k AS v FROM mut WHERE k IS NOT NULL
       UNION ALL SELECT model_id, node, seq, op, 'extra', extra FROM mut WHERE extra IS NOT NULL
       UNION ALL SELECT model_id, node, seq, op, 'value', value FROM mut WHERE value IS NOT NULL),
     lagged AS (SELECT *, lag(v) OVER (PARTITION BY model_id, node, key ORDER BY seq) AS old FROM keyed),
     changed AS (SELECT model_id, node, seq, string_agg(concat('"', key, '":', v), ',' ORDER BY key) AS body
       FROM lagged WHERE op = 'CREATE' OR v IS DISTINCT FROM old GROUP BY model_id, node, seq)
     SELECT m.model_id, m.node, m.seq,
       CASE WHEN m.op = 'TOMBSTONE' THEN '{"_tombstoned":true}' ELSE concat('{', coalesce(c.body, ''), '}') END AS delta
     FROM mut m LEFT JOIN changed c USING (model_id, node, seq)""",
)
def mutation_delta(spark, folder):
    found = log.deltas(mutations(spark, folder))
    return found.select("model_id", "node", "seq", canonical_json(F.col("delta")).alias("delta"))


@query(
    "event_types",
    "WITH"
    + SQL_MUTATIONS
    + """SELECT concat(op, '_NODE') AS event_type, count(*) AS n FROM mut GROUP BY op
       UNION ALL SELECT 'CREATE_EDGE', count(*) FROM orders""",
)
def event_types(spark, folder):
    made = mutations(spark, folder).select("operation", "type")
    placed = table(spark, folder, "orders").select(F.lit("CREATE").alias("operation"), F.lit("#edge/PLACED_BY").alias("type"))
    return made.unionByName(placed).withColumn("event_type", log.event_type()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


SQL_STATES = "SELECT model_id, node, seq, json AS state FROM evt"


@query("post_state_history", "WITH" + SQL_HISTORY + SQL_STATES)
def post_state_history(spark, folder):
    found = log.histories(mutations(spark, folder), STATE_KEYS)
    return found.select("model_id", "node", "seq", canonical_json(F.col("payload")).alias("state"))


@query("post_state_history_open", "WITH" + SQL_HISTORY + SQL_STATES)
def post_state_history_open(spark, folder):
    found = log.open_histories(mutations(spark, folder))
    return found.select("model_id", "node", "seq", canonical_json(F.col("payload")).alias("state"))


@query(
    "state_at",
    "WITH"
    + SQL_HISTORY
    + """SELECT model_id, node, max(seq) AS seq, max_by(value, seq) AS value, max_by(k, seq) AS k,
       max_by(extra, seq) AS extra, max_by(gone, seq) AS tombstoned FROM hist
       WHERE event_time <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY model_id, node""",
)
def state_at(spark, folder):
    found = log.state_at(events(spark, folder), at("2024-01-20 00:00:00"))
    return found.select("model_id", "node", "seq", *state_columns(found, "state"), F.col("state")["extra"].alias("extra"), "tombstoned")


@query(
    "state_as_of_join",
    "WITH"
    + SQL_HISTORY
    + """, probe AS (SELECT DISTINCT model_id, node, event_time + INTERVAL 6 HOUR AS as_of FROM mut)
       SELECT p.model_id, p.node, epoch_us(p.as_of) AS as_of, h.seq, h.value, h.k, h.gone AS tombstoned
       FROM probe p ASOF LEFT JOIN hist h ON p.model_id = h.model_id AND p.node = h.node AND p.as_of >= h.event_time""",
)
def state_as_of_join(spark, folder):
    probes = mutations(spark, folder).select(
        "model_id", "node", (F.col("event_time") + F.expr("INTERVAL 6 HOURS")).alias("as_of")
    ).distinct()
    found = log.state_as_of(events(spark, folder), probes)
    return found.select("model_id", "node", _micros("as_of"), "seq", *state_columns(found), "tombstoned")


@query(
    "node_history",
    "WITH"
    + SQL_HISTORY
    + """SELECT seq, op AS operation, source_system, conn AS origin_connector_id, value, k, epoch_us(event_time) AS event_time
       FROM hist WHERE model_id = 't1' AND node = 'user:7'""",
)
def node_history(spark, folder):
    found = log.history(events(spark, folder), "t1", "user:7")
    return found.select("seq", "operation", "source_system", "origin_connector_id", *state_columns(found), _micros("event_time"))


def _config(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('t0', 14, TIMESTAMP'2024-01-03 00:00:00'), ('t1', 7, NULL), ('t2', NULL, NULL)"
        " AS c(model_id, retention_days, snapshot_boundary)"
    )


SQL_EXPIRED = """expired AS (SELECT model_id, seq FROM hist WHERE
   (model_id = 't0' AND event_time < TIMESTAMP '2024-01-11 00:00:00' AND event_time > TIMESTAMP '2024-01-03 00:00:00')
   OR (model_id = 't1' AND event_time < TIMESTAMP '2024-01-18 00:00:00'))"""


@query("retention", "WITH" + SQL_HISTORY + "," + SQL_EXPIRED + "SELECT model_id, node, seq FROM hist ANTI JOIN expired USING (model_id, seq)")
def retention(spark, folder):
    kept = log.retain(events(spark, folder), _config(spark), at("2024-01-25 00:00:00"))
    return kept.select("model_id", "node", "seq")


@query(
    "retention_counts",
    "WITH" + SQL_HISTORY + "," + SQL_EXPIRED + "SELECT model_id, count(*) AS deleted FROM expired GROUP BY model_id",
)
def retention_counts(spark, folder):
    return log.purge_counts(events(spark, folder), _config(spark), at("2024-01-25 00:00:00"))


@query(
    "echo_suppress",
    "WITH"
    + SQL_MUTATIONS
    + """SELECT model_id, seq, seq > min(seq) OVER (PARTITION BY model_id, conn, change) AS echo FROM mut""",
)
def echo_suppress(spark, folder):
    return log.mark_echoes(mutations(spark, folder)).select("model_id", "seq", "echo")


@query(
    "echo_suppress_with_log",
    "WITH"
    + SQL_MUTATIONS
    + """, recent AS (SELECT * FROM mut WHERE event_time >= TIMESTAMP '2024-01-20 00:00:00')
     SELECT r.model_id, r.seq, EXISTS (SELECT 1 FROM mut o WHERE o.model_id = r.model_id AND o.conn = r.conn
       AND o.change = r.change AND o.seq < r.seq) AS echo FROM recent r""",
)
def echo_suppress_with_log(spark, folder):
    m = mutations(spark, folder)
    cut = at("2024-01-20 00:00:00")
    marked = log.mark_echoes(m.filter(F.col("event_time") >= cut), log=m.filter(F.col("event_time") < cut))
    return marked.select("model_id", "seq", "echo")


SQL_RATE = """, dense AS (SELECT model_id, conn, seq, CAST(floor(epoch_us(event_time) / 1000000 / 6000) AS BIGINT) AS sec FROM mut),
  counted AS (SELECT *, count(*) OVER (PARTITION BY conn, model_id ORDER BY sec RANGE BETWEEN 29 PRECEDING AND 1 PRECEDING)
     + row_number() OVER (PARTITION BY conn, model_id, sec ORDER BY seq) AS in_window FROM dense),
  trips AS (SELECT conn, model_id, min_by(seq, seq) AS trip_seq, min_by(sec, seq) AS trip_second, min_by(in_window, seq) AS events_in_window
     FROM counted WHERE in_window > CASE WHEN conn = 'c1' AND model_id = 't1' THEN 60 ELSE 30 END GROUP BY conn, model_id)
"""


def _fast(spark, folder):
    """Time squeezed so that a hundred minutes pass as a second."""
    squeezed = F.timestamp_micros(F.floor(F.unix_micros("event_time") / 6000).cast("long"))
    return mutations(spark, folder).withColumn("event_time", squeezed)


def _limits(spark):
    return spark.sql("SELECT 'c1' AS origin_connector_id, 't1' AS model_id, 2 AS threshold")


@query(
    "rate_breaker_trips",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RATE
    + "SELECT conn AS origin_connector_id, model_id, trip_seq, trip_second, events_in_window FROM trips",
)
def rate_breaker_trips(spark, folder):
    return log.rate_trips(_fast(spark, folder), _limits(spark), per_second=1)


@query(
    "rate_breaker",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RATE
    + """SELECT m.model_id, m.seq, coalesce(m.seq >= t.trip_seq, false) AS halted
       FROM mut m LEFT JOIN trips t ON m.conn = t.conn AND m.model_id = t.model_id""",
)
def rate_breaker(spark, folder):
    m = _fast(spark, folder)
    return log.mark_halted(m, log.rate_trips(m, _limits(spark), per_second=1)).select("model_id", "seq", "halted")


SQL_CHAIN = """, evs AS (SELECT model_id, seq, json, row_number() OVER (PARTITION BY model_id ORDER BY seq) AS i FROM evt),
 links AS (
  SELECT model_id, i, seq, sha256(concat(sha256('GENESIS'), json)) AS prev_hash FROM evs WHERE i = 1
  UNION ALL
  SELECT e.model_id, e.i, e.seq, sha256(concat(l.prev_hash, e.json)) FROM links l JOIN evs e ON e.model_id = l.model_id AND e.i = l.i + 1)
"""


@query("chain_build", "WITH RECURSIVE" + SQL_HISTORY + SQL_CHAIN + "SELECT model_id, seq, prev_hash FROM links")
def chain_build(spark, folder):
    return chain.build_chain(events(spark, folder)).select("model_id", "seq", "prev_hash")


@query(
    "chain_verify",
    "WITH RECURSIVE"
    + SQL_HISTORY
    + SQL_CHAIN
    + """, stored AS (SELECT l.model_id, l.seq, l.i,
         CASE WHEN l.model_id = 't2' AND l.seq = (SELECT max(seq) FROM evt WHERE model_id = 't2') THEN NULL ELSE l.prev_hash END AS prev_hash,
         CASE WHEN e.model_id = 't1' AND e.op = 'TOMBSTONE' THEN concat(e.json, ' ') ELSE e.json END AS json
         FROM links l JOIN evt e USING (model_id, seq)),
     again AS (SELECT *, sha256(concat(coalesce(lag(prev_hash) OVER (PARTITION BY model_id ORDER BY seq), sha256('GENESIS')),
         CASE WHEN ends_with(json, ' ') THEN '{"k":0}' ELSE json END)) AS expected FROM stored),
     breaks AS (SELECT model_id, min(seq) AS broken_seq, min_by(expected, seq) AS expected, min_by(prev_hash, seq) AS actual
         FROM again WHERE expected IS DISTINCT FROM prev_hash GROUP BY model_id)
     SELECT a.model_id, any_value(b.broken_seq) IS NULL AS valid,
        count(*) FILTER (WHERE b.broken_seq IS NULL OR a.seq < b.broken_seq) AS events_checked,
        any_value(b.broken_seq) AS broken_seq, any_value(b.expected) AS expected, any_value(b.actual) AS actual
     FROM again a LEFT JOIN breaks b USING (model_id) GROUP BY a.model_id""",
)
def chain_verify(spark, folder):
    log_rows = materialise(events(spark, folder))
    hashes = chain.build_chain(log_rows)
    tampered = (F.col("model_id") == "t1") & (F.col("operation") == "TOMBSTONE")
    payload = F.when(tampered, F.create_map(F.lit("k"), F.lit("0"))).otherwise(F.col("payload"))
    tails = log_rows.filter("model_id = 't2'").agg(F.max("seq").alias("_tail"))
    stored = log_rows.join(hashes, ["model_id", "seq"]).withColumn("payload", payload).join(F.broadcast(tails))
    stripped = (F.col("model_id") == "t2") & (F.col("seq") == F.col("_tail"))
    stored = stored.withColumn("prev_hash", F.when(~stripped, F.col("prev_hash"))).drop("_tail")
    return chain.verify_chain(stored)


SQL_COMPACT = """, folded AS (SELECT model_id, node, max(seq) AS seq, max_by(json, seq) AS json FROM evt
    WHERE event_time < TIMESTAMP '2024-01-22 00:00:00' GROUP BY model_id, node)
"""


@query(
    "compaction",
    "WITH"
    + SQL_HISTORY
    + SQL_COMPACT
    + """SELECT model_id, node, seq, event_type, json AS payload FROM evt WHERE event_time >= TIMESTAMP '2024-01-22 00:00:00'
     UNION ALL SELECT model_id, node, seq, 'SNAPSHOT', json FROM folded""",
)
def compaction(spark, folder):
    compacted, _ = chain.compact(events(spark, folder), at("2024-01-22 00:00:00"))
    return compacted.select("model_id", "node", "seq", "event_type", canonical_json(F.col("payload")).alias("payload"))


@query(
    "compaction_time_travel",
    "WITH"
    + SQL_HISTORY
    + ", moments AS (SELECT unnest([TIMESTAMP '2024-01-22 00:00:00', TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-03-01 00:00:00']) AS t)"
    + """SELECT epoch_us(t) AS at, model_id, node, max_by(json, seq) AS state, max_by(gone, seq) AS tombstoned
     FROM evt JOIN moments ON event_time <= t GROUP BY t, model_id, node""",
)
def compaction_time_travel(spark, folder):
    """States read from the compacted log, against those of the full log."""
    compacted, _ = chain.compact(events(spark, folder), at("2024-01-22 00:00:00"))
    out = None
    for moment in ("2024-01-22 00:00:00", "2024-01-24 00:00:00", "2024-03-01 00:00:00"):
        found = log.state_at(compacted, at(moment)).select(
            F.unix_micros(at(moment)).alias("at"), "model_id", "node", canonical_json(F.col("state")).alias("state"), "tombstoned"
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "compaction_counts",
    "WITH"
    + SQL_HISTORY
    + """SELECT model_id, count(DISTINCT node) AS written, count(*) AS deleted FROM evt
       WHERE event_time < TIMESTAMP '2024-01-22 00:00:00' GROUP BY model_id""",
)
def compaction_counts(spark, folder):
    return chain.compact(events(spark, folder), at("2024-01-22 00:00:00"))[1]


@query(
    "newest_snapshots",
    "WITH" + SQL_HISTORY + "SELECT model_id, node, max(seq) AS seq, max_by(json, seq) AS payload FROM evt GROUP BY model_id, node",
)
def newest_snapshots(spark, folder):
    once, _ = chain.compact(events(spark, folder), at("2024-01-22 00:00:00"))
    twice, _ = chain.compact(once, at("2024-03-01 00:00:00"))
    left = chain.newest_snapshots(twice)
    return left.select("model_id", "node", "seq", canonical_json(F.col("payload")).alias("payload"))


@query(
    "outbox_rows",
    "WITH"
    + SQL_HISTORY
    + """SELECT concat(model_id, ':', seq) AS event_id, concat(model_id, '.user') AS aggregatetype, node AS aggregateid,
       event_type AS type, json AS payload, conn AS hint FROM evt""",
)
def outbox_rows(spark, folder):
    routed = F.create_map(F.lit("connector"), F.col("origin_connector_id"))
    rows = log.outbox(events(spark, folder), routed)
    return rows.select("event_id", "aggregatetype", "aggregateid", "type", "payload", F.col("routing_hints")["connector"].alias("hint"))


@query(
    "outbox_next_batch",
    "WITH"
    + SQL_HISTORY
    + """SELECT concat(model_id, ':', seq) AS event_id FROM evt WHERE event_type <> 'UPDATE_NODE'
       ORDER BY event_time, event_id LIMIT 100""",
)
def outbox_next_batch(spark, folder):
    rows = log.outbox(events(spark, folder))
    return log.next_batch(rows, rows.filter(F.col("type") == "UPDATE_NODE")).select("event_id")


@query(
    "outbox_lag",
    "WITH" + SQL_MUTATIONS + "SELECT count(*) AS pending FROM mut WHERE op <> 'UPDATE'",
)
def outbox_lag(spark, folder):
    rows = log.outbox(events(spark, folder))
    return log.pending(rows, rows.filter(F.col("type") == "UPDATE_NODE")).agg(F.count(F.lit(1)).alias("pending"))


def _edge_mutations(spark, folder):
    """Orders and customers as edge writes; every tenth order is removed again."""
    from graphlog.functions.literals import quote

    def ends(df, src_type, src, dst_type, dst):
        return F.create_map(
            F.lit("sourceUuid"), quote(F.concat(F.lit(f"{src_type}:"), F.col(src).cast("string"))),
            F.lit("targetUuid"), quote(F.concat(F.lit(f"{dst_type}:"), F.col(dst).cast("string"))),
            F.lit("sourceLabel"), F.lit(f'"{src_type}"'), F.lit("targetLabel"), F.lit(f'"{dst_type}"'),
        )

    orders = table(spark, folder, "orders").withColumn("tenant", F.concat(F.lit("t"), (F.col("o_orderkey") % 2).cast("string")))
    made = orders.select(
        F.col("tenant").alias("model_id"), (F.col("o_orderkey") * 2 + 1000000).alias("seq"), F.lit("CREATE").alias("operation"),
        F.lit("#edge/PLACED_BY").alias("type"), F.concat(F.lit("e:"), F.col("o_orderkey").cast("string")).alias("node"),
        ends(orders, "order", "o_orderkey", "customer", "o_custkey").alias("payload"),
    )
    gone = orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("tenant").alias("model_id"), (F.col("o_orderkey") * 2 + 1000001).alias("seq"), F.lit("TOMBSTONE").alias("operation"),
        F.lit("#edge/PLACED_BY").alias("type"), F.concat(F.lit("e:"), F.col("o_orderkey").cast("string")).alias("node"),
        ends(orders, "order", "o_orderkey", "customer", "o_custkey").alias("payload"),
    )
    return made.unionByName(gone).withColumn("event_time", at("2024-01-05 00:00:00")).withColumn(
        "source_id", F.lit("load")).withColumn("source_system", F.lit("orders"))


def _ends(spark, folder):
    return nodes(spark, folder, only=["order", "customer"]).select("model_id", "node", "type", F.col("seq").alias("first_seq"))


@query(
    "apply_edges",
    """SELECT concat('t', o_orderkey % 2) AS model_id, concat('e:', o_orderkey) AS edge, 'PLACED_BY' AS label,
       concat('order:', o_orderkey) AS src, concat('customer:', o_custkey) AS dst, o_orderstatus = 'F' AS tombstoned
       FROM orders WHERE o_orderkey % 2 = o_custkey % 2 AND o_custkey IN (SELECT c_custkey FROM customer)""",
)
def apply_edges(spark, folder):
    checked = state.check_edges(state.edge_writes(_edge_mutations(spark, folder)), _ends(spark, folder))
    folded = state.fold_edges(checked.filter(F.col("error").isNull()))
    return folded.select("model_id", "edge", "label", "src", "dst", "tombstoned")


@query(
    "edge_rejections",
    """SELECT concat('t', o_orderkey % 2) AS model_id, concat('e:', o_orderkey) AS edge, 'ENDPOINT_NOT_FOUND' AS error
       FROM orders WHERE o_orderkey % 2 <> o_custkey % 2 OR o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def edge_rejections(spark, folder):
    checked = state.check_edges(state.edge_writes(_edge_mutations(spark, folder)), _ends(spark, folder))
    return checked.filter(F.col("error").isNotNull()).select("model_id", "edge", "error")


@query(
    "hard_delete",
    "WITH"
    + SQL_EDGES
    + """, dead AS (SELECT concat('customer:', c_custkey) AS n FROM customer WHERE c_mktsegment = 'MACHINERY')
     SELECT label, count(*) AS n FROM edg WHERE src NOT IN (SELECT n FROM dead) AND dst NOT IN (SELECT n FROM dead) GROUP BY label
     UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def hard_delete(spark, folder):
    everyone = nodes(spark, folder, tenants=1, only=["customer"])
    left, linked = state.hard_delete(everyone, edges(spark, folder), everyone.filter("tombstoned"))
    return linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(
        left.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
