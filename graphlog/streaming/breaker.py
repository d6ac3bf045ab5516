"""The write-rate breaker on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphlog.operators.log import EVENTS_PER_SECOND, WINDOW_SECONDS

_OUT = "origin_connector_id string, model_id string, seq bigint, halted boolean"


class Breaker(StatefulProcessor):
    """Counts of the last half minute per second, and a latch."""

    def __init__(self, per_second: int):
        self._allowed = per_second * WINDOW_SECONDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tripped = handle.getValueState("tripped", "seq bigint")
        self._counts = handle.getMapState("counts", "second bigint", "n bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        latch = int(self._tripped.get()[0]) if self._tripped.exists() else None
        counts = {int(k[0]): int(v[0]) for k, v in self._counts.iterator()}
        before = set(counts)
        total, oldest = sum(counts.values()), None
        if latch is None:
            for seq, second in zip(batch["seq"], batch["second"]):
                if second != oldest:
                    for s in [s for s in counts if s <= second - WINDOW_SECONDS]:
                        total -= counts.pop(s)
                    oldest = second
                counts[second] = counts.get(second, 0) + 1
                total += 1
                if total > self._allowed:
                    latch = int(seq)
                    self._tripped.update((latch,))
                    break
            for s in before - set(counts):
                self._counts.removeKey((s,))
            for s, n in counts.items():
                self._counts.updateValue((int(s),), (int(n),))
        halted = batch["seq"] >= latch if latch is not None else False
        yield pd.DataFrame({"origin_connector_id": key[0], "model_id": key[1], "seq": batch["seq"], "halted": halted})

    def close(self) -> None:
        pass


def breaker_stream(mutations: DataFrame, per_second: int = EVENTS_PER_SECOND) -> DataFrame:
    """Each connector write with ``halted``; the latch holds until the state
    is dropped. A task holds one micro-batch of a pair's keys, so size the
    source's trigger with that in mind.
    """
    writes = mutations.filter(F.coalesce(F.trim("origin_connector_id") != "", F.lit(False))).select(
        "origin_connector_id", "model_id", "seq", F.floor(F.unix_micros("event_time") / 1_000_000).cast("long").alias("second")
    )
    grouped = writes.groupBy("origin_connector_id", "model_id")
    return grouped.transformWithStateInPandas(Breaker(per_second), _OUT, "append", "none")


def rate_alerts(mutations: DataFrame, per_second: int = EVENTS_PER_SECOND, late: str = "1 minute") -> DataFrame:
    """Alert-only form: sliding half minutes whose count is above the limit."""
    window = F.window("event_time", f"{WINDOW_SECONDS} seconds", "1 second").alias("window")
    counted = mutations.withWatermark("event_time", late).groupBy(window, "origin_connector_id", "model_id").agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.filter(F.col("events") > per_second * WINDOW_SECONDS)
