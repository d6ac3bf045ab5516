"""Small mutation logs and plain sequential models to compare with."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from graphlog.model import MUTATION_SCHEMA

START = dt.datetime(2024, 1, 1)


def mutation(seq, node, op="UPDATE", payload=None, model="t0", source="A", **more):
    row = {
        "model_id": model, "seq": seq, "event_time": START + dt.timedelta(minutes=seq), "operation": op, "type": "person", "node": node,
        "payload": payload or {}, "source_type": "STRUCTURED", "source_id": f"s{seq}", "source_system": source,
        "confidence": Decimal("1.000"), "origin_connector_id": None, "origin_change_id": None,
    }
    row.update(more)
    return row


def frame(spark, rows):
    names = [f.name for f in MUTATION_SCHEMA]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MUTATION_SCHEMA)


def random_log(seed, size=300, nodes=6, tenants=2, keys=("a", "b", "c"), sources=("A", "B", "C", "D")):
    rnd = random.Random(seed)
    born, rows = set(), []
    for seq in range(1, size + 1):
        # a third of all rows belong to one node
        model, node = ("t0", "n0") if rnd.random() < 0.34 else (f"t{rnd.randrange(tenants)}", f"n{rnd.randrange(nodes)}")
        op = "CREATE" if (model, node) not in born else rnd.choice(["UPDATE"] * 9 + ["TOMBSTONE"])
        born.add((model, node))
        payload = {k: str(rnd.randrange(4)) for k in keys if rnd.random() < 0.5}
        if op == "TOMBSTONE":
            payload = {keys[0]: "9"}  # must not count
        elif rnd.random() < 0.1:
            payload |= {"stray": str(rnd.randrange(4)), "_updated_at": '"mine"'}
        rows.append(mutation(seq, node, op, payload, model, rnd.choice(sources)))
    return rows


def replay(rows):
    """(state per event with its tombstone mark, final properties) by walking the log in order."""
    state, events = {}, {}
    for r in sorted(rows, key=lambda r: (r["model_id"], r["seq"])):
        key = (r["model_id"], r["node"])
        wrote = {k: v for k, v in r["payload"].items() if k not in ("_created_at", "_updated_at")}
        state[key] = {**state.get(key, {}), **({"_tombstoned": "true"} if r["operation"] == "TOMBSTONE" else wrote)}
        events[r["model_id"], r["seq"]] = dict(state[key])
    return events, {key: {k: v for k, v in props.items() if k != "_tombstoned"} for key, props in state.items()}
