"""The write funnel: a batch of mutations in, state and log tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import overlay
from graphlog.model import CHUNK_ROWS, CREATE, EDGE_PREFIX
from graphlog.operators import log, reconcile, rules, shapes, state
from graphlog.storage import materialise

NODE = ["model_id", "node"]


@dataclass(frozen=True)
class FunnelResult:
    nodes: DataFrame
    edges: DataFrame
    events: DataFrame
    outbox: DataFrame
    conflicts: DataFrame
    dlq: DataFrame


def _existence(rows: DataFrame, ok: Column, base: DataFrame | None) -> DataFrame:
    """Add ``_lost``: a first write that is no CREATE, or a second CREATE."""
    made = rows.filter(ok & (F.col("operation") == CREATE)).groupBy(*NODE).agg(F.min("seq").alias("_born"))
    if base is not None:
        made = made.unionByName(base.select(*NODE, F.lit(-(1 << 63)).alias("_born")))
        made = made.groupBy(*NODE).agg(F.min("_born").alias("_born"))
    create = F.col("operation") == CREATE
    early = F.col("_born").isNull() | (F.col("seq") < F.col("_born"))
    lost = F.when(create & (F.col("seq") != F.col("_born")), F.lit("DUPLICATE_CREATE")).when(
        ~create & early, F.lit("NODE_NOT_FOUND")
    )
    return rows.join(made, NODE, "left").withColumn("_lost", F.when(ok, lost))


def run_funnel(
    mutations: DataFrame,
    registry: DataFrame,
    authority: DataFrame,
    user_rules: list[rules.Rule] | None = None,
    rule_config: DataFrame | None = None,
    base: DataFrame | None = None,
    event_log: DataFrame | None = None,
    mode: str = "creator",
    keys: list[str] | None = None,
    chunk: int = CHUNK_ROWS,
) -> FunnelResult:
    """Rules, shape, existence, reconciliation, then events and messages.

    Each stage decides all rows at once: stateless checks first, echoes among
    the rows that pass them, existence among the rest, and property authority
    over the survivors. The verdicts are written once and read by every
    output. Stricter than one row at a time in two cases: a badly typed value
    that would have lost to the current one is refused, and an echo stays
    refused when the row it repeats fails for existence.
    """
    is_edge = F.col("type").startswith(EDGE_PREFIX)
    checked = log.check_envelopes(mutations)
    checked = rules.evaluate(checked, user_rules or [], rule_config)
    checked = shapes.check_shapes(checked, registry)
    passes = F.col("error").isNull() & F.col("reject_reason").isNull() & (F.size("violations") == 0)
    checked = log.mark_echoes(checked, event_log, counts=passes)
    clean = passes & ~F.col("echo") & ~is_edge
    checked = _existence(checked, clean, base)

    reason = (
        F.when(F.col("error").isNotNull(), F.lit("INVALID_ENVELOPE"))
        .when(F.col("echo") | F.col("reject_reason").isNotNull(), F.lit("RULE_REJECT"))
        .when(F.size("violations") > 0, F.lit("SHACL_VIOLATION"))
        .otherwise(F.col("_lost"))
    )
    echo_text = F.concat(
        F.lit("change "), F.col("origin_change_id"), F.lit(" of connector "), F.col("origin_connector_id"), F.lit(" came before"),
    )
    detail = F.coalesce(
        "error", F.when(F.col("echo"), echo_text), "reject_reason",
        F.when(F.size("violations") > 0, F.concat(F.size("violations").cast("string"), F.lit(" violations"))), "_lost",
    )
    rule_id = F.when(F.col("echo"), F.lit("echo-loop-suppression")).otherwise(F.col("rejected_by"))
    verdicts = materialise(
        checked.withColumn("_reason", reason).withColumn("_detail", detail).withColumn("_rule", rule_id)
        .drop("_born", "_lost", "error", "reject_reason", "rejected_by", "echo")
    )
    kept = verdicts.filter(F.col("_reason").isNull())
    envelope = [c for c in mutations.columns]
    accepted = kept.filter(~is_edge).select(*envelope, "routing_hints", "rule_conflicts")

    settled = materialise(reconcile.settle(accepted, authority, mode, base, chunk))
    written = materialise(reconcile.apply_settled(accepted, settled))

    changes = log.deltas(written, chunk).select("model_id", "seq", "delta")
    seeded = written
    if base is not None:
        mark = F.create_map(F.lit(log.TOMBSTONED), F.lit("true"))
        held = F.when(F.col("tombstoned"), overlay(F.col("props"), mark)).otherwise(F.col("props"))
        stored = base.select(*NODE, "seq", held.alias("payload"))
        seeded = written.unionByName(stored, allowMissingColumns=True)
    states = log.histories(seeded, keys, chunk) if keys else log.open_histories(seeded, chunk)
    if base is not None:
        states = states.join(written.select("model_id", "seq"), ["model_id", "seq"], "left_semi")
    node_events = states.join(changes, ["model_id", "seq"])

    writes = state.edge_writes(kept)
    born = accepted.filter(F.col("operation") == CREATE).select(*NODE, "type", F.col("seq").alias("first_seq"))
    if base is not None:
        born = born.unionByName(base.select(*NODE, "type", F.lit(-(1 << 63)).alias("first_seq")))
    edge_checked = materialise(state.check_edges(writes, born))
    edges_ok = edge_checked.filter(F.col("error").isNull())
    edge_rows = kept.filter(is_edge).join(
        edges_ok.select("model_id", "seq", F.col("props").alias("_props")), ["model_id", "seq"]
    )
    gone = F.create_map(F.lit("_tombstoned"), F.lit("true"))
    edge_events = edge_rows.select(
        *[c for c in envelope if c != "payload"], "routing_hints", F.col("_props").alias("payload"),
        F.when(F.col("operation") == "TOMBSTONE", gone).otherwise(F.col("_props")).alias("delta"),
    )
    events = node_events.drop("rule_conflicts").unionByName(edge_events)
    events = events.withColumn("event_type", log.event_type()).withColumn("event_id", F.concat_ws(":", "model_id", "seq"))

    refused = shapes.rejected(verdicts.filter(F.col("_reason").isNotNull()), F.col("_reason"), F.col("_detail"), F.col("_rule"))
    lost_edges = kept.join(
        edge_checked.filter(F.col("error").isNotNull()).select("model_id", "seq", "error"), ["model_id", "seq"]
    )
    refused = refused.unionByName(shapes.rejected(lost_edges, F.col("error"), F.col("error"), F.lit(None).cast("string")))

    register = reconcile.conflicts(settled)
    by_rule = accepted.select(*NODE, "seq", "type", F.explode("rule_conflicts").alias("c")).select(*NODE, "seq", "type", "c.*")
    return FunnelResult(
        nodes=state.fold_nodes(written, base),
        edges=state.fold_edges(edges_ok),
        events=events,
        outbox=log.outbox(events, F.col("routing_hints")),
        conflicts=register.unionByName(by_rule.select(*register.columns)),
        dlq=refused,
    )
