from functools import reduce

import pytest
from helpers import frame, mutation, random_log
from pyspark.sql import functions as F

from graphlog.operators import log, reconcile, rules, shapes
from graphlog.operators.rules import Rule
from graphlog.plans.funnel import run_funnel

AUTHORITY = "model_id string, type string, property string, priority_order array<string>"
REGISTRY = "model_id string, type string, property string, data_type string, required boolean"


def authority(spark, *rows):
    return spark.createDataFrame(list(rows), AUTHORITY)


def sequential(rows, ranks, mode):
    """One row at a time, as the rule is stated."""
    value, owner, made, out = {}, {}, {}, {}
    far = 10**9
    for r in sorted(rows, key=lambda r: r["seq"]):
        node, s = (r["model_id"], r["node"]), r["source_system"]
        made.setdefault(node, s)
        if r["operation"] == "TOMBSTONE":
            continue
        for k, v in r["payload"].items():
            order = ranks.get((r["model_id"], k))
            if order is None:
                continue
            key = (*node, k)
            current = value.get(key)
            holder = made[node] if mode == "creator" else owner.get(key)
            rank = {x: i for i, x in enumerate(order)}
            contested = current is not None and current != v and holder != s
            wins = not contested or rank.get(s, far) < rank.get(holder, far)
            if current is not None and current == v and mode == "last_owner" and holder != s:
                wins = rank.get(s, far) < rank.get(holder, far)
            if wins:
                value[key], owner[key] = v, s
            out[(*key, r["seq"])] = (value[key], contested)
    return out


@pytest.mark.parametrize("mode", ["creator", "last_owner"])
@pytest.mark.parametrize("chunk", [6, 1 << 20])
def test_settle_equals_sequential(spark, mode, chunk):
    rows = random_log(11, 400)
    ranks = {("t0", "a"): ["B", "A"], ("t0", "b"): ["C"], ("t1", "a"): ["D", "B"]}
    table = authority(spark, *[(m, "person", p, o) for (m, p), o in ranks.items()])
    settled = reconcile.settle(frame(spark, rows), table, mode, chunk=chunk).collect()
    want = sequential(rows, ranks, mode)
    got = {(r.model_id, r.node, r.property, r.seq): (r.value if r.accepted else r.current, r.contested) for r in settled}
    assert got == want


@pytest.mark.parametrize("first,second", [("A", "B"), ("B", "A")])
def test_the_ranked_source_wins_in_both_orders(spark, first, second):
    rows = [mutation(1, "n", "CREATE", {"status": f'"{first}"'}, source=first), mutation(2, "n", "UPDATE", {"status": f'"{second}"'}, source=second)]
    settled = reconcile.settle(frame(spark, rows), authority(spark, ("t0", "person", "status", ["A", "B"])))
    assert reconcile.settled_values(settled).first().value == '"A"'
    (clash,) = reconcile.conflicts(settled).collect()
    assert (clash.losing_source, clash.winning_source, clash.losing_source_id) == ("B", "A", "s2")
    assert clash.winning_source_id == ("" if first == "A" else "s2")


def one(spark, *listed, payload=None, config=None):
    m = frame(spark, [mutation(1, "n", "CREATE", payload or {"a": "1"})])
    return rules.evaluate(m, list(listed), config).first()


def test_priority_order_and_reject_stop(spark):
    row = one(
        spark,
        Rule("low", "VALIDATE", 1, "reject", F.lit("low")), Rule("high", "VALIDATE", 9, "reject", F.lit("high")),
        Rule("add", "ENRICH", 5, "add", F.lit("2"), None, "b"),
    )
    assert (row.rejected_by, row.reject_reason, row.payload) == ("high", "high", {"a": "1"})


def test_add_keeps_and_merge_replaces(spark):
    row = one(
        spark,
        Rule("m", "RECONCILE", 5, "merge", F.lit("7"), None, "a"), Rule("add-a", "ENRICH", 5, "add", F.lit("0"), None, "a"),
        Rule("add-b", "ENRICH", 5, "add", F.lit("1"), None, "b"), Rule("add-b2", "ENRICH", 4, "add", F.lit("2"), None, "b"),
    )
    assert row.payload == {"a": "7", "b": "1"} and row.rule_conflicts == [] and row.rejected_by is None


def test_override_records_both_sides_and_routes_merge(spark):
    row = one(
        spark,
        Rule("o", "RECONCILE", 5, "override", F.lit("9"), None, "a", F.lit("A"), F.lit("1")),
        Rule("r1", "ROUTE", 5, "route", F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("1"))),
        Rule("r2", "ROUTE", 1, "route", F.create_map(F.lit("y"), F.lit("2"))),
    )
    (c,) = row.rule_conflicts
    assert (c.property, c.losing_source, c.losing_value, c.winning_value, c.winning_source_id) == ("a", "A", "1", "9", "")
    assert row.routing_hints == {"x": "1", "y": "2"}


def test_tenant_settings_switch_and_move_rules(spark):
    config = spark.createDataFrame([("t0", "high", False, None), ("t0", "low", True, 50)], "model_id string, rule_id string, enabled boolean, priority_override int")
    listed = [Rule("low", "VALIDATE", 1, "reject", F.lit("l")), Rule("mid", "VALIDATE", 5, "reject", F.lit("m")), Rule("high", "VALIDATE", 9, "reject", F.lit("h"))]
    assert one(spark, *listed, config=config).rejected_by == "low"
    assert [(r.rule_id, r.priority) for r in rules.active_rules(listed, config).orderBy("position").collect()] == [("low", 50), ("mid", 5)]


PERSON = [
    ("t0", "person", "name", "string", True), ("t0", "person", "email", "string", True), ("t0", "person", "age", "int", False),
    ("t0", "person", "active", "boolean", False), ("t0", "person", "ref", "uuid", False), ("t0", "person", "seen", "datetime", False),
]


def faults(spark, payload, scope="payload", state=None):
    m = frame(spark, [mutation(1, "n", "CREATE", payload)])
    got = shapes.check_shapes(m, spark.createDataFrame(PERSON, REGISTRY), scope, state)
    return [(v.path, v.constraint[:8]) for v in got.first().violations]


def test_shapes(spark):
    fine = {"name": '"x"', "email": '"y"', "age": "3", "active": "true", "seen": '"2024-01-01T00:00:00Z"', "other": "1"}
    assert faults(spark, fine) == []
    assert faults(spark, {"name": '"x"'}) == [("email", "MinCount")]
    assert faults(spark, {**fine, "age": "1.5", "active": '"yes"', "name": "null"}) == [("active", "Datatype"), ("age", "Datatype"), ("name", "MinCount")]
    assert faults(spark, {**fine, "ref": '"nope"', "seen": '"soon"'}) == [("ref", "PatternC"), ("seen", "Datatype")]
    assert faults(spark, {**fine, "ref": '"0b5b7d5c-0000-4000-8000-00000000000a"', "name": "1.5"}) == []
    merged = F.create_map(F.lit("name"), F.lit('"x"'), F.lit("email"), F.lit('"y"'))
    assert faults(spark, {"age": "3"}, "merged", merged) == []


def test_report_and_letters_hold_no_values_and_connectors_only(spark):
    rows = [mutation(1, "n", "CREATE", {"name": '"secret"'}, origin_connector_id="c"), mutation(2, "n", "CREATE", {"name": '"secret"'})]
    checked = shapes.check_shapes(frame(spark, rows), spark.createDataFrame(PERSON, REGISTRY))
    report = shapes.report(checked)
    assert report.columns == ["model_id", "focus", "seq", "path", "constraint", "severity"] and "secret" not in str(report.collect())
    letters = shapes.rejected(checked, F.lit("SHACL_VIOLATION"), F.lit("d"), F.lit(None)).collect()
    assert [r.seq for r in letters] == [1] and "secret" in letters[0].raw_payload


def test_funnel_verdicts_and_outputs(spark):
    ends = {"sourceUuid": '"a"', "targetUuid": '"b"', "sourceLabel": '"person"', "targetLabel": '"person"'}
    base = {"name": '"x"', "email": '"y"'}
    rows = [
        mutation(1, "a", "CREATE", base, origin_connector_id="c", origin_change_id="1"),
        mutation(2, "b", "CREATE", base, origin_connector_id="c", origin_change_id="2"),
        mutation(3, "a", "CREATE", base, origin_connector_id="c", origin_change_id="3"),
        mutation(4, "z", "UPDATE", base, origin_connector_id="c", origin_change_id="4"),
        mutation(5, "a", "UPDATE", base, origin_connector_id="c", origin_change_id="1"),
        mutation(6, "a", "UPDATE", {"name": '"x"'}, origin_connector_id="c", origin_change_id="6"),
        mutation(7, "a", "UPDATE", {**base, "email": '"B"'}, source="B"),
        mutation(8, "e", "CREATE", ends, type="#edge/KNOWS"),
        mutation(9, "e2", "CREATE", {**ends, "targetUuid": '"q"'}, type="#edge/KNOWS", origin_connector_id="c", origin_change_id="9"),
        mutation(10, "b", "UPDATE", {**base, "name": '"bad"'}, origin_connector_id="c", origin_change_id="10"),
    ]
    guard = [Rule("no-bad", "VALIDATE", 5, "reject", F.lit("bad name"), F.col("payload")["name"] == '"bad"')]
    got = run_funnel(
        frame(spark, rows), spark.createDataFrame(PERSON, REGISTRY), authority(spark, ("t0", "person", "email", ["A", "B"])), guard,
    )
    assert {r.seq: (r.reason, r.rule_id) for r in got.dlq.collect()} == {
        3: ("DUPLICATE_CREATE", None), 4: ("NODE_NOT_FOUND", None), 5: ("RULE_REJECT", "echo-loop-suppression"),
        6: ("SHACL_VIOLATION", None), 9: ("ENDPOINT_NOT_FOUND", None), 10: ("RULE_REJECT", "no-bad"),
    }
    assert {r.seq: r.event_type for r in got.events.collect()} == {1: "CREATE_NODE", 2: "CREATE_NODE", 7: "UPDATE_NODE", 8: "CREATE_EDGE"}
    assert {r.node: r.props["email"] for r in got.nodes.collect()} == {"a": '"y"', "b": '"y"'}
    assert [(r.losing_source, r.winning_source) for r in got.conflicts.collect()] == [("B", "A")]
    assert [r.edge for r in got.edges.collect()] == ["e"]
    assert {r.aggregatetype for r in got.outbox.collect()} == {"t0.person", "t0.#edge/KNOWS"}


def test_funnel_in_steps_equals_whole(spark):
    rows = [r for r in random_log(12, 160)]
    table = authority(spark, ("t0", "person", "a", ["B", "A"]), ("t1", "person", "b", ["C"]))
    empty = spark.createDataFrame([], REGISTRY)
    m = frame(spark, rows)
    whole = run_funnel(m, empty, table)
    first = run_funnel(m.filter("seq <= 90"), empty, table)
    second = run_funnel(m.filter("seq > 90"), empty, table, base=first.nodes, event_log=first.events)

    def state(df):
        return {(r.model_id, r.node): (r.props, r.seq, r.tombstoned, r.source) for r in df.collect()}

    assert state(second.nodes) == state(whole.nodes)
    events = lambda df: {(r.model_id, r.seq): r.payload for r in df.collect()}
    assert reduce(lambda a, b: {**a, **b}, [events(first.events), events(second.events)]) == events(whole.events)


def test_tenants_do_not_see_each_other(spark):
    rows = random_log(13, 120)
    table = authority(spark, ("t0", "person", "a", ["B"]), ("t1", "person", "a", ["C"]))
    both = frame(spark, rows)
    for tenant in ("t0", "t1"):
        alone = both.filter(F.col("model_id") == tenant)
        for make in (lambda m: reconcile.settle(m, table), lambda m: log.deltas(m), lambda m: log.histories(m, ["a", "b"])):
            want = sorted(map(str, make(alone).collect()))
            assert sorted(map(str, make(both).filter(F.col("model_id") == tenant).collect())) == want
