"""The mutation log: checks, order, deltas, history, time travel, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.functions.literals import canonical_json, overlay
from graphlog.model import (
    CHUNK_ROWS,
    CREATE,
    EDGE_PREFIX,
    IDENTIFIER,
    OPERATIONS,
    OWNED_KEYS,
    SNAPSHOT,
    SOURCE_TYPES,
    TOMBSTONE,
    UPDATE,
)
from graphlog.operators.runs import in_pieces, large_groups, ranges, running

NODE = ["model_id", "node"]
_REQUIRED = ["model_id", "operation", "type", "payload", "source_type", "source_id", "source_system", "confidence"]
_ENDPOINTS = ["sourceUuid", "targetUuid", "sourceLabel", "targetLabel"]


def is_edge() -> Column:
    return F.col("type").startswith(EDGE_PREFIX)


def envelope_error(available: list[str]) -> Column:
    """First fault of a mutation's envelope, or null."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in _REQUIRED if c in available]
    checks.append(F.when(~F.col("operation").isin(OPERATIONS), F.lit("unknown operation")))
    if "source_type" in available:
        checks.append(F.when(~F.col("source_type").isin(SOURCE_TYPES), F.lit("unknown source type")))
    if "confidence" in available:
        checks.append(F.when(~F.col("confidence").between(0, 1), F.lit("confidence must be in [0,1]")))
    name = F.when(is_edge(), F.substring("type", len(EDGE_PREFIX) + 1, 1 << 30)).otherwise(F.col("type"))
    checks.append(F.when(~name.rlike(IDENTIFIER), F.lit("illegal type")))
    keys_fit = F.forall(F.map_keys("payload"), lambda k: k.rlike(IDENTIFIER))
    checks.append(F.when(~keys_fit, F.lit("illegal property key")))
    targeted = F.col("operation").isin(UPDATE, TOMBSTONE) & F.col("node").isNull()
    checks.append(F.when(targeted, F.lit("target node is required")))
    ends = [F.coalesce(F.col("payload")[k], F.lit('""')).isin('""', "null") for k in _ENDPOINTS]
    missing = ends[0] | ends[1] | ends[2] | ends[3]
    checks.append(F.when(is_edge() & missing, F.lit("edge endpoints are required")))
    checks.append(F.when(is_edge() & (F.col("operation") == UPDATE), F.lit("edge update is not supported")))
    return F.coalesce(*checks)


def check_envelopes(mutations: DataFrame) -> DataFrame:
    """Add ``error``: null for a well-formed mutation."""
    return mutations.withColumn("error", envelope_error(mutations.columns))


def event_type() -> Column:
    return F.concat_ws("_", F.col("operation"), F.when(is_edge(), F.lit("EDGE")).otherwise(F.lit("NODE")))


TOMBSTONED = "_tombstoned"


def writes_of(mutations: DataFrame) -> DataFrame:
    """``mutations`` with the payload that takes effect.

    A TOMBSTONE writes its mark and nothing else, and the mark stays; keys the
    log owns are never taken from a caller.
    """
    empty = F.create_map().cast("map<string,string>")
    mark = F.create_map(F.lit(TOMBSTONED), F.lit("true"))
    own = F.map_filter(F.coalesce("payload", empty), lambda k, v: ~k.isin(OWNED_KEYS))
    return mutations.withColumn("payload", F.when(F.col("operation") == TOMBSTONE, mark).otherwise(own))


def is_tombstoned(payload: Column) -> Column:
    return F.coalesce(payload[TOMBSTONED] == "true", F.lit(False))


def deltas(mutations: DataFrame, chunk: int = CHUNK_ROWS, large: DataFrame | None = None) -> DataFrame:
    """Add ``delta``: the whole payload of a CREATE, the changed keys of an
    UPDATE, a marker for a TOMBSTONE.

    Each property is compared with its own previous value, so no full state
    is built. An UPDATE can only change keys it carries.
    """
    if large is None:
        large = large_groups(mutations, NODE, chunk)
    key = NODE + ["_key"]
    effective = writes_of(mutations)
    writes = effective.select(*NODE, "seq", "operation", F.explode("payload").alias("_key", "_value"))
    seen = running(writes, key, "seq", {"_old": ("last", F.col("_value"))}, inclusive=False, chunk=chunk, large=large)
    changed = seen.filter((F.col("operation") == CREATE) | ~F.col("_value").eqNullSafe(F.col("_old")))
    per_row = changed.groupBy(*NODE, "seq").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_key", "_value")))).alias("_changed")
    )
    empty = F.create_map().cast("map<string,string>")
    marker = F.create_map(F.lit(TOMBSTONED), F.lit("true"))
    delta = F.when(F.col("operation") == TOMBSTONE, marker).otherwise(F.coalesce("_changed", empty))
    return mutations.join(per_row, NODE + ["seq"], "left").withColumn("delta", delta).drop("_changed")


def histories(
    mutations: DataFrame,
    keys: list[str],
    chunk: int = CHUNK_ROWS,
    large: DataFrame | None = None,
) -> DataFrame:
    """Replace ``payload`` by the node's full state after each mutation.

    ``keys`` are the property names that most writes use (the registry's):
    each is one running column, all in one window pass. Nodes that ever write
    another property carry those through :func:`open_histories`.
    """
    effective = writes_of(mutations)
    listed = [*dict.fromkeys(keys), *([] if TOMBSTONED in keys else [TOMBSTONED])]
    wanted = {f"_v{i}": ("last", F.col("payload")[k]) for i, k in enumerate(listed)}
    filled = running(effective, NODE, "seq", wanted, chunk=chunk, large=large)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{i}").alias("v")) for i, k in enumerate(listed)])
    state = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    filled = filled.withColumn("payload", state).drop(*wanted)

    others = effective.select(*NODE, "seq", "operation", F.map_filter("payload", lambda k, v: ~k.isin(listed)).alias("payload"))
    unlisted = others.filter(F.size("payload") > 0).select(*NODE).distinct()
    rest = _carry_all(others.join(unlisted, NODE, "left_semi"), chunk, large).select(*NODE, "seq", F.col("payload").alias("_rest"))
    both = filled.join(rest, NODE + ["seq"], "left")
    merged = F.when(F.col("_rest").isNull(), F.col("payload")).otherwise(overlay(F.col("_rest"), F.col("payload")))
    return both.withColumn("payload", merged).select(*mutations.columns)


def _fold(batches: Iterator[pd.DataFrame], keep_first: bool) -> Iterator[pd.DataFrame]:
    """Running merge over rows sorted by group and order; one map is held."""
    current, state = None, {}
    for batch in batches:
        out = []
        for group, carry, payload in zip(batch["_group"], batch["_carry"], batch["payload"]):
            if group != current:
                current, state = group, dict(carry or {})
            if keep_first:
                out.append(dict(state))
            state.update(dict(payload or {}))
            if not keep_first:
                out.append(dict(state))
        yield batch.assign(payload=out)


def open_histories(mutations: DataFrame, chunk: int = CHUNK_ROWS, large: DataFrame | None = None) -> DataFrame:
    """``histories`` for property names that no registry lists."""
    return _carry_all(writes_of(mutations), chunk, large)


def _carry_all(mutations: DataFrame, chunk: int, large: DataFrame | None) -> DataFrame:
    """Running merge of whole maps.

    Rows are sorted by node and order inside each partition and folded batch
    by batch. A large node is cut into pieces; each piece starts from the
    merged last values of the pieces before it.
    """
    columns = mutations.columns
    pieces, hot = in_pieces(mutations, NODE, "seq", chunk, large)
    key = NODE + ["_piece"]
    last = (
        hot.select(*key, "seq", F.explode_outer("payload").alias("_k", "_v"))
        .groupBy(*key, "_k")
        .agg(F.max_by("_v", "seq").alias("_v"))
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))).alias("payload"))
    )
    empty = F.create_map().cast("map<string,string>")

    def fold(rows: DataFrame, order: list[str], group: list[str], keep_first: bool) -> DataFrame:
        tagged = rows.withColumn("_group", F.to_json(F.array(*[F.col(c).cast("string") for c in group])))
        placed = tagged.repartition(*group).sortWithinPartitions("_group", *order)
        return placed.mapInPandas(lambda it: _fold(it, keep_first), placed.schema).drop("_group", "_carry")

    carried = fold(last.withColumn("_carry", empty), ["_piece"], NODE, True)
    carried = carried.select(*key, F.col("payload").alias("_carry"))
    started = pieces.join(carried, key, "left").withColumn("_carry", F.coalesce("_carry", empty))
    return fold(started, ["seq"], key, False).select(*columns)


def state_at(events: DataFrame, at: Column, node: str | None = None, model_id: str | None = None) -> DataFrame:
    """State of every node (or one) at an instant: its last event up to then.

    When the log carries ``event_month`` the month bound is stated too, so
    that later months are pruned.
    """
    past = events.filter(F.col("event_time") <= at)
    if "event_month" in events.columns:
        past = past.filter(F.col("event_month") <= F.date_format(at, "yyyy-MM"))
    if model_id is not None:
        past = past.filter(F.col("model_id") == model_id)
    if node is not None:
        past = past.filter(F.col("node") == node)
    latest = past.groupBy(*NODE).agg(
        F.max_by(F.struct("seq", "event_time", "payload"), "seq").alias("_last"),
        F.bool_or(F.col("operation") == TOMBSTONE).alias("_gone"),
    )
    gone = F.coalesce("_gone", F.lit(False)) | is_tombstoned(F.col("_last.payload"))
    mark = F.create_map(F.lit(TOMBSTONED), F.lit("true"))
    state = F.when(gone, overlay(F.col("_last.payload"), mark)).otherwise(F.col("_last.payload"))
    return latest.select(*NODE, "_last.seq", "_last.event_time", gone.alias("tombstoned"), state.alias("state"))


def state_as_of(events: DataFrame, probes: DataFrame, parts: int | None = None) -> DataFrame:
    """Per probe (model_id, node, as_of): the node's state at that instant.

    Only keys, times and sequence numbers go through the range sort; the
    state itself is fetched by one equi-join on the found sequence number.
    """
    by = NODE
    past = events.select(*by, F.col("event_time").alias("_at"), F.lit(0).alias("_probe"), F.col("seq").alias("_seq"))
    asked = probes.select(*by, "as_of").distinct()
    asked = asked.select(*by, F.col("as_of").alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("_seq"))
    rows = ranges(past.unionByName(asked), by, ["_at", "_probe", "_seq"], parts)

    inside = Window.partitionBy(*by, "_range").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_range").agg(F.max("_seq").alias("_top"))
    spans = tops.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*by)
    carried = tops.join(F.broadcast(spans), by, "left_semi").select(*by, "_range", F.max("_top").over(before).alias("_pre"))
    found = (
        rows.withColumn("_run", F.max("_seq").over(inside))
        .filter(F.col("_probe") == 1)
        .join(carried, by + ["_range"], "left")
        .select(*by, F.col("_at").alias("as_of"), F.greatest("_run", "_pre").alias("seq"))
        .filter(F.col("seq").isNotNull())
    )
    state = events.select(*by, "seq", "event_time", "operation", "payload", is_tombstoned(F.col("payload")).alias("tombstoned"))
    hits = found.join(state, by + ["seq"])
    return probes.join(hits, by + ["as_of"], "left")


def history(events: DataFrame, model_id: str, node: str) -> DataFrame:
    """One node's events in order."""
    return events.filter((F.col("model_id") == model_id) & (F.col("node") == node)).orderBy("seq")


def _expired(as_of: Column) -> Column:
    cutoff = F.unix_micros(as_of) - F.col("retention_days").cast("long") * 86_400_000_000
    boundary = F.coalesce(F.unix_micros("snapshot_boundary"), F.lit(-(1 << 63)))
    at = F.unix_micros("event_time")
    kind = F.col("event_type") != SNAPSHOT
    return F.coalesce(kind & (at < cutoff) & (at > boundary), F.lit(False))


def retain(events: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """Events kept by each tenant's retention days; no days keeps all."""
    policy = config.select("model_id", "retention_days", "snapshot_boundary")
    return events.join(policy, "model_id", "left").filter(~_expired(as_of)).select(*events.columns)


def purge_counts(events: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """Events each tenant's retention would delete."""
    policy = config.filter(F.col("retention_days").isNotNull())
    policy = policy.select("model_id", "retention_days", "snapshot_boundary")
    per_tenant = events.join(policy, "model_id").filter(_expired(as_of)).groupBy("model_id").count()
    return policy.select("model_id").join(per_tenant, "model_id", "left").select(
        "model_id", F.coalesce("count", F.lit(0)).alias("deleted")
    )


ORIGIN = ["model_id", "origin_connector_id", "origin_change_id"]


def mark_echoes(mutations: DataFrame, log: DataFrame | None = None, counts: Column | None = None) -> DataFrame:
    """Add ``echo``: the same tenant, connector and change id came before.

    ``counts`` says which rows can make a later one an echo (those that pass
    the other checks); rows without both ids never match.
    """
    named = F.col("origin_connector_id").isNotNull() & F.col("origin_change_id").isNotNull()
    source = mutations.filter(named)
    if counts is not None:
        source = source.filter(counts)
    first = source.groupBy(*ORIGIN).agg(F.min("seq").alias("_first"))
    if log is not None:
        known = log.filter(named).select(*ORIGIN).distinct().withColumn("_first", F.lit(-(1 << 63)))
        first = first.unionByName(known).groupBy(*ORIGIN).agg(F.min("_first").alias("_first"))
    echo = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    return mutations.join(first, ORIGIN, "left").withColumn("echo", echo).select(*mutations.columns, "echo")


# The breaker's window and its default allowance.
WINDOW_SECONDS = 30
EVENTS_PER_SECOND = 500
_HOUR = 3600


def rate_trips(
    mutations: DataFrame,
    limits: DataFrame | None = None,
    per_second: int = EVENTS_PER_SECOND,
    grace_until: Column | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Per (connector, tenant): the write that trips the rate breaker, if any.

    Writes are first counted per second, so the sliding sum runs over
    seconds, cut into hours that repeat the half minute before them. Rows are
    looked at one by one only inside the one second that trips. ``since`` is
    the moment the breakers were last reset.
    """
    pair = ["origin_connector_id", "model_id"]
    writes = mutations.filter(F.coalesce(F.trim("origin_connector_id") != "", F.lit(False)))
    if since is not None:
        writes = writes.filter(F.col("event_time") >= since)
    writes = writes.withColumn("_second", F.floor(F.unix_micros("event_time") / 1_000_000).cast("long"))
    seconds = writes.groupBy(*pair, "_second").agg(F.count(F.lit(1)).alias("_n"))
    window_max = per_second
    allowed = F.lit(per_second)
    if limits is not None:
        per_pair = limits.select(*pair, F.col("threshold").alias("_threshold"))
        seconds = seconds.join(per_pair, pair, "left")
        allowed = F.coalesce(F.col("_threshold"), allowed)
        top = limits.agg(F.max("threshold")).first()[0]
        window_max = max(per_second, int(top or 0))
    seconds = seconds.withColumn("_allowed", allowed.cast("long") * WINDOW_SECONDS)

    hour = F.floor(F.col("_second") / _HOUR).cast("long")
    overlap = F.col("_second") % _HOUR >= _HOUR - (WINDOW_SECONDS - 1)
    hours = F.when(overlap, F.array(hour, hour + 1)).otherwise(F.array(hour))
    sliding = Window.partitionBy(*pair, "_hour").orderBy("_second").rangeBetween(-(WINDOW_SECONDS - 1), -1)
    summed = (
        seconds.withColumn("_hour", F.explode(hours))
        .withColumn("_prior", F.coalesce(F.sum("_n").over(sliding), F.lit(0)))
        .filter(F.col("_hour") == hour)
    )
    over = F.col("_prior") + F.col("_n") > F.col("_allowed")
    if grace_until is not None:
        over = over & (F.col("_second") >= F.floor(F.unix_micros(grace_until) / 1_000_000))
    need = F.greatest(F.col("_allowed") - F.col("_prior") + 1, F.lit(1))
    first = summed.filter(over).groupBy(*pair).agg(
        F.min_by(F.struct("_second", "_prior", need.alias("_need")), "_second").alias("_t")
    )
    first = first.select(*pair, "_t.*")
    order = Window.partitionBy(*pair).orderBy("seq")
    ranked = writes.join(first, pair + ["_second"]).withColumn("_rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("_rank") <= window_max * WINDOW_SECONDS + 1)
    return ranked.filter(F.col("_rank") == F.col("_need")).select(
        *pair,
        F.col("seq").alias("trip_seq"),
        F.col("_second").alias("trip_second"),
        (F.col("_prior") + F.col("_rank")).alias("events_in_window"),
    )


def mark_halted(mutations: DataFrame, trips: DataFrame) -> DataFrame:
    """Add ``halted``: the write that tripped a breaker and all after it."""
    pair = ["origin_connector_id", "model_id"]
    halted = F.coalesce(F.col("seq") >= F.col("trip_seq"), F.lit(False))
    joined = mutations.join(trips.select(*pair, "trip_seq"), pair, "left").withColumn("halted", halted)
    return joined.select(*mutations.columns, "halted")


def outbox(events: DataFrame, routing: Column | None = None) -> DataFrame:
    """One outgoing message per event, with its routing hints."""
    hints = routing if routing is not None else F.create_map().cast("map<string,string>")
    return events.select(
        F.col("event_id"),
        "model_id",
        F.concat_ws(".", "model_id", "type").alias("aggregatetype"),
        F.col("node").alias("aggregateid"),
        F.col("event_type").alias("type"),
        canonical_json(F.col("payload")).alias("payload"),
        hints.alias("routing_hints"),
        F.col("event_time").alias("created_at"),
    )


def pending(messages: DataFrame, delivered: DataFrame) -> DataFrame:
    """Messages not yet in the delivery ledger."""
    return messages.join(delivered.select("event_id"), "event_id", "left_anti")


def next_batch(messages: DataFrame, delivered: DataFrame, size: int = 100) -> DataFrame:
    """The oldest pending messages, a batch at a time."""
    return pending(messages, delivered).orderBy("created_at", "event_id").limit(size)
