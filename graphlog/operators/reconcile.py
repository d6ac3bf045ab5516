"""Settling disagreements between source systems, property by property.

Only properties with a row in the authority table are looked at; every other
write is accepted as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import overlay
from graphlog.model import CHUNK_ROWS, TOMBSTONE
from graphlog.operators.runs import running

NODE = ["model_id", "node"]
RULE_ID = "authority-reconciliation"
_UNLISTED = (1 << 31) - 1


def _rank(source):
    place = F.array_position("priority_order", source)
    return F.when(place > 0, place - 1).otherwise(F.lit(_UNLISTED))


def governed_writes(mutations: DataFrame, authority: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row per write of a governed property, with the node's creator."""
    made = mutations.select(*NODE, "seq", "source_system")
    live = mutations.filter((F.col("operation") != TOMBSTONE) & F.col("payload").isNotNull())
    writes = live.select(
        *NODE, "type", "seq", "source_system", F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.lit(False).alias("stored"), F.explode("payload").alias("property", "value"),
    )
    if base is not None:
        made = made.unionByName(base.select(*NODE, "seq", F.col("source").alias("source_system")))
        writes = writes.unionByName(
            base.select(
                *NODE, "type", "seq", F.col("source").alias("source_system"), "source_id",
                F.lit(True).alias("stored"), F.explode("props").alias("property", "value"),
            )
        )
    creators = made.groupBy(*NODE).agg(F.min_by("source_system", "seq").alias("creator"))
    ruled = writes.filter(F.col("value") != "null").join(authority, ["model_id", "type", "property"])
    return ruled.join(creators, NODE).withColumn("creator", F.coalesce("creator", F.lit("")))


def settle(
    mutations: DataFrame,
    authority: DataFrame,
    mode: str = "creator",
    base: DataFrame | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Decide every governed write: ``accepted``, ``current`` value, ``contested``.

    ``creator``: all properties belong to the system that created the node.
    A later write stands if it comes from that system or from one ranked
    above it; ties keep the current value. Acceptance then needs no history,
    only the value before a write does.

    ``last_owner``: an accepted write also takes ownership, so a write must
    outrank (or be) the best-ranked writer so far.
    """
    key = NODE + ["property"]
    writes = governed_writes(mutations, authority, base).withColumn("rank", _rank(F.col("source_system")))
    if mode == "creator":
        outranks = F.col("rank") < _rank(F.col("creator"))
        stands = (F.col("creator") == "") | (F.col("source_system") == F.col("creator")) | outranks
        seen = running(
            writes.withColumn("_stands", stands), key, "seq",
            {"_last": ("last", F.when(F.col("_stands"), F.col("value"))), "_first": ("first", F.col("value"))},
            inclusive=False, chunk=chunk,
        )
        current = F.coalesce("_last", "_first")
        decided = seen.select(
            "*", current.alias("current"), F.col("creator").alias("owner"), (F.col("_stands") | current.isNull()).alias("accepted")
        )
    elif mode == "last_owner":
        seen = running(
            writes, key, "seq",
            {"_best": ("min", F.col("rank")), "_first": ("first", F.col("source_system"))},
            inclusive=False, chunk=chunk,
        )
        level = (F.col("rank") < _UNLISTED) | (F.col("source_system") == F.col("_first"))
        stands = F.col("_best").isNull() | (F.col("rank") < F.col("_best")) | ((F.col("rank") == F.col("_best")) & level)
        owned = seen.withColumn("accepted", stands)
        held = F.when(F.col("accepted"), F.struct(F.col("value").alias("v"), F.col("source_system").alias("s")))
        decided = running(owned, key, "seq", {"_held": ("last", held)}, inclusive=False, chunk=chunk)
        decided = decided.select("*", F.col("_held.v").alias("current"), F.coalesce("_held.s", F.lit("")).alias("owner"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    contested = (
        F.col("current").isNotNull()
        & (F.col("current") != F.col("value"))
        & (F.col("owner") != "")
        & (F.col("owner") != F.col("source_system"))
    )
    return decided.filter(~F.col("stored")).select(
        *key, "type", "seq", "source_system", "source_id", "value", "accepted", "current", "owner",
        contested.alias("contested"),
    )


def conflicts(settled: DataFrame) -> DataFrame:
    """The conflict register: both sides of every contested write.

    The losing id is the incoming one whichever side wins, and the winning id
    is blank when the current value stays.
    """
    won = F.col("accepted")
    return settled.filter("contested").select(
        *NODE, "seq", "type", "property",
        F.col("source_id").alias("losing_source_id"),
        F.when(won, F.col("owner")).otherwise(F.col("source_system")).alias("losing_source"),
        F.when(won, F.col("current")).otherwise(F.col("value")).alias("losing_value"),
        F.when(won, F.col("source_id")).otherwise(F.lit("")).alias("winning_source_id"),
        F.when(won, F.col("source_system")).otherwise(F.col("owner")).alias("winning_source"),
        F.when(won, F.col("value")).otherwise(F.col("current")).alias("winning_value"),
        F.lit(RULE_ID).alias("rule_id"),
    )


def settled_values(settled: DataFrame) -> DataFrame:
    """Final value of every governed property: the last accepted write."""
    return settled.groupBy(*NODE, "property").agg(
        F.max_by("value", F.when(F.col("accepted"), F.col("seq"))).alias("value")
    )


def apply_settled(mutations: DataFrame, settled: DataFrame) -> DataFrame:
    """Put the current value in place of each write that was not accepted."""
    kept = settled.filter(~F.col("accepted")).groupBy(*NODE, "seq").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "current")))).alias("_kept")
    )
    payload = overlay(F.col("payload"), F.col("_kept"))
    return mutations.join(kept, NODE + ["seq"], "left").withColumn("payload", payload).drop("_kept")
