"""Counts and health summaries over the log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.storage import materialise

#: An hour in microseconds, the unit of all sums on call times.
HOUR = 3_600_000_000
QUOTA_EXCEEDED = "QUOTA_EXCEEDED"


def run_metrics(events: DataFrame, evaluated: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per tenant: events stored, mutations put through rules, conflicts."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))

    joined = counted(events, "ingested").join(counted(evaluated, "evaluated"), "model_id", "full_outer")
    joined = joined.join(counted(conflicts, "conflicts"), "model_id", "full_outer")
    return joined.na.fill(0)


def connector_health(connectors: DataFrame, status: DataFrame) -> DataFrame:
    """Enabled connectors with their last outcome; no run yet reads null."""
    last = status.select("connector_id", "last_outcome", "last_poll_at")
    return connectors.filter("enabled").join(last, "connector_id", "left")


def overall_health(health: DataFrame) -> DataFrame:
    """DOWN when any enabled connector's last run failed."""
    failed = F.max(F.when(F.col("last_outcome") == "FAILED", 1).otherwise(0))
    return health.agg(F.when(failed == 1, F.lit("DOWN")).otherwise(F.lit("UP")).alias("status"))


def calls_since(calls: DataFrame, since: Column) -> DataFrame:
    """Calls per tenant and agent since a time, refused ones left out."""
    counted = calls.filter((F.col("called_at") >= since) & (F.col("outcome") != QUOTA_EXCEEDED))
    return counted.groupBy("model_id", "agent_id").agg(F.count(F.lit(1)).alias("calls"))


def clock_hour_usage(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """Calls per agent and clock hour against the hourly quota.

    Hours are those of the clock, not counted from an agent's first call.

    No quota, or none above zero, is exceeded by the first call.
    """
    hour = F.date_trunc("hour", "called_at").alias("hour")
    used = calls.groupBy("model_id", "agent_id", hour).agg(F.count(F.lit(1)).alias("used"))
    return _against(used, quotas, "hour")


def _against(used: DataFrame, quotas: DataFrame, window: str) -> DataFrame:
    joined = used.join(quotas.select("model_id", "agent_id", "per_hour"), ["model_id", "agent_id"], "left")
    allowed = F.greatest(F.coalesce("per_hour", F.lit(0)), F.lit(0))
    return joined.select("model_id", "agent_id", window, "used", allowed.alias("allowed"), (F.col("used") > allowed).alias("exceeded"))


def _next_windows(times: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, next): the first call more than an hour after each call, if any.

    It is looked for in the clock hour where it could first be, else it is the
    first call of the agent's next hour that has one. Windows hold an agent's
    call times of one clock hour, or its clock hours.
    """
    t = F.col("t")
    calls = times.select(*key, F.col("at").alias("t"), F.lit(None).cast("long").alias("at"))
    probes = times.select(*key, (F.col("at") + HOUR + 1).alias("t"), "at")
    rows = calls.unionByName(probes).withColumn("hour", t - F.pmod(t, F.lit(HOUR)))
    call = F.when(F.col("at").isNull(), t)
    # latest first, so that the running minimum over a call and those after it is one pass
    within = rows.withColumn("inside", F.min(call).over(Window.partitionBy(*key, "hour").orderBy(F.desc("t"))))
    hours = rows.groupBy(*key, "hour").agg(F.min(call).alias("opened"))
    after = Window.partitionBy(*key).orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(*key, "hour", F.min("opened").over(after).alias("later"))
    found = within.filter(F.col("at").isNotNull()).join(hours, [*key, "hour"])
    return found.select(*key, "at", F.coalesce("inside", "later").alias("next")).filter(F.col("next").isNotNull())


def hourly_usage(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """Calls per agent and hour against the quota, hours counted from first use.

    An agent's first call opens an hour; the first call more than an hour
    later opens the next one, so that a call exactly an hour after the opening
    still belongs to it. ``opened_at`` names the hour. Calls of no tenant,
    agent or time are left out; no quota, or none above zero, is exceeded by
    the first call.

    Which calls open an hour depends on all before them. Jumps to the next
    opening are joined to themselves, doubling in length, until no agent has
    further to go: as many rounds as the hours of the busiest agent have binary
    digits, and no agent is walked in one task.
    """
    key = ["model_id", "agent_id"]
    known = calls.select(*key, F.unix_micros("called_at").alias("at")).dropna()
    times = materialise(known.groupBy(*key, "at").agg(F.count(F.lit(1)).alias("used")))
    jumps = materialise(_next_windows(times, key))
    opened = times.groupBy(*key).agg(F.min("at").alias("at"))
    while True:
        fresh = materialise(opened.join(jumps, [*key, "at"]).select(*key, F.col("next").alias("at")))
        if fresh.isEmpty():
            break
        opened = opened.unionByName(fresh)
        on = jumps.select(*key, F.col("at").alias("next"), F.col("next").alias("_further"))
        jumps = materialise(jumps.join(on, [*key, "next"]).select(*key, "at", F.col("_further").alias("next")))

    def hour(at: Column) -> Column:
        return at - F.pmod(at, F.lit(HOUR))

    # an opening's calls lie in its own clock hour or the one after
    start = F.col("at")
    reach = opened.select(*key, start.alias("_start"), F.explode(F.array(hour(start), hour(start) + HOUR)).alias("_hour"))
    met = times.withColumn("_hour", hour(start)).join(reach, [*key, "_hour"])
    within = met.filter((start >= F.col("_start")) & (start <= F.col("_start") + HOUR))
    used = within.groupBy(*key, F.timestamp_micros("_start").alias("opened_at")).agg(F.sum("used").alias("used"))
    return _against(used, quotas, "opened_at")
