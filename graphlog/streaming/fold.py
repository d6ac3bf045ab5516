"""Continuous fold of a mutation stream into node state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphlog.model import OWNED_KEYS, TOMBSTONE

_PARTIAL = (
    "model_id string, node string, first_seq bigint, last_seq bigint, type string, created_at timestamp, source string,"
    " source_id string, updated_at timestamp, tombstoned_at timestamp, writes array<struct<k:string,v:string,s:bigint>>"
)
_STATE = (
    "model_id string, node string, seq bigint, type string, created_at timestamp, updated_at timestamp, source string,"
    " source_id string, tombstoned_at timestamp, props map<string,string>"
)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per node and batch: a map-side combine ahead of the shuffle."""
    for batch in batches:
        partial: dict[tuple, dict] = {}
        for r in batch.itertuples(index=False):
            p = partial.setdefault((r.model_id, r.node), {"first": None, "last": None, "gone": None, "writes": {}})
            if p["first"] is None or r.seq < p["first"].seq:
                p["first"] = r
            if p["last"] is None or r.seq > p["last"].seq:
                p["last"] = r
            if r.operation == TOMBSTONE:
                p["gone"] = r.event_time if p["gone"] is None else max(p["gone"], r.event_time)
                continue
            for k, v in dict(r.payload or {}).items():
                if k not in OWNED_KEYS and (k not in p["writes"] or p["writes"][k][1] < r.seq):
                    p["writes"][k] = (v, r.seq)
        rows = [
            (m, n, p["first"].seq, p["last"].seq, p["first"].type, p["first"].event_time, p["first"].source_system or "",
             p["first"].source_id or "", p["last"].event_time, p["gone"], [{"k": k, "v": v, "s": s} for k, (v, s) in p["writes"].items()])
            for (m, n), p in partial.items()
        ]
        names = ["model_id", "node", "first_seq", "last_seq", "type", "created_at", "source", "source_id", "updated_at", "tombstoned_at", "writes"]
        out = pd.DataFrame(rows, columns=names)
        for c in ("created_at", "updated_at", "tombstoned_at"):
            out[c] = pd.to_datetime(out[c])
        yield out


class NodeFold(StatefulProcessor):
    """Keeps, per node, each property's last value with its sequence number.

    A write older than the stored one is ignored, so rows may arrive in any
    order and the result equals the batch fold.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState(
            "head",
            "first_seq bigint, last_seq bigint, type string, created_at bigint, source string, source_id string, updated_at bigint, gone bigint",
        )
        self._props = handle.getMapState("props", "k string", "v string, s bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        head = self._head.get() if self._head.exists() else None
        for batch in rows:
            for r in batch.itertuples(index=False):
                gone = None if pd.isna(r.tombstoned_at) else pd.Timestamp(r.tombstoned_at).value // 1000
                fresh = (int(r.first_seq), int(r.last_seq), r.type, pd.Timestamp(r.created_at).value // 1000, r.source, r.source_id,
                         pd.Timestamp(r.updated_at).value // 1000, gone)
                head = fresh if head is None else _older_head(tuple(head), fresh)
                for w in r.writes:
                    k, v, s = w["k"], w["v"], int(w["s"])
                    if not self._props.containsKey((k,)) or self._props.getValue((k,))[1] < s:
                        self._props.updateValue((k,), (v, s))
        self._head.update(head)
        props = {k[0]: v[0] for k, v in self._props.iterator()}
        first, last, kind, created, source, source_id, updated, gone = head
        yield pd.DataFrame(
            {
                "model_id": [key[0]], "node": [key[1]], "seq": [last], "type": [kind],
                "created_at": [pd.Timestamp(created, unit="us")], "updated_at": [pd.Timestamp(updated, unit="us")],
                "source": [source], "source_id": [source_id],
                "tombstoned_at": pd.to_datetime([None if gone is None else pd.Timestamp(gone, unit="us")]), "props": [props],
            }
        )

    def close(self) -> None:
        pass


def _older_head(a: tuple, b: tuple) -> tuple:
    first = a if a[0] <= b[0] else b
    last = a if a[1] >= b[1] else b
    gone = max([g for g in (a[7], b[7]) if g is not None], default=None)
    return (first[0], last[1], first[2], first[3], first[4], first[5], last[6], gone)


def fold_stream(mutations: DataFrame) -> DataFrame:
    """Changed node states per micro-batch, in update mode.

    Needs the RocksDB state store: state holds one entry per live node and
    property. Keep the row with the highest ``seq`` per node downstream.
    """
    columns = ["model_id", "node", "seq", "operation", "type", "event_time", "source_system", "source_id", "payload"]
    combined = mutations.select(*columns).mapInPandas(_combine, _PARTIAL)
    return combined.groupBy("model_id", "node").transformWithStateInPandas(NodeFold(), _STATE, "update", "none")
