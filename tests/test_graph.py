import random

import pytest
from pyspark.sql import functions as F

from graphlog.operators import graph, read
from graphlog.operators.graph import Hop, Spot

EDGES = "model_id string, label string, src string, dst string"


def random_edges(seed, nodes=30, size=60):
    rnd = random.Random(seed)
    out = {("t0", "R", "n00", f"n{i:02}") for i in range(1, 12)}  # a hub
    while len(out) < size:
        out.add((f"t{rnd.randrange(2)}", rnd.choice("RS"), f"n{rnd.randrange(nodes):02}", f"n{rnd.randrange(nodes):02}"))
    return sorted(out)


def neighbours(edges, model):
    near = {}
    for m, _, a, b in edges:
        if m == model:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def path(near, src, dst, hops):
    dist, front = {src: 0}, [src]
    for d in range(1, hops + 1):
        front = sorted({b for a in front for b in near.get(a, ()) if b not in dist})
        dist.update({b: d for b in front})
        if dst in dist:
            break
    if dst not in dist or src == dst:
        return None
    out = [dst]
    while out[0] != src:
        out.insert(0, min(a for a in near[out[0]] if dist.get(a) == dist[out[0]] - 1))
    return out


@pytest.mark.parametrize("hops", [10, 2])
def test_shortest_paths_equal_bfs(spark, hops):
    edges = random_edges(1)
    rnd = random.Random(2)
    pairs = {(f"t{rnd.randrange(2)}", f"n{rnd.randrange(32):02}", f"n{rnd.randrange(32):02}") for _ in range(40)}
    found = graph.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(sorted(pairs), "model_id string, src string, dst string"), hops)
    got = {(r.model_id, r.src, r.dst): (r.path, r.length) for r in found.collect()}
    want = {}
    for m, a, b in pairs:
        p = path(neighbours(edges, m), a, b, hops)
        if p:
            want[m, a, b] = (p, len(p) - 1)
    assert got == want


def test_paths_stay_in_their_tenant(spark):
    edges = spark.createDataFrame([("t0", "R", "A", "B"), ("t0", "R", "B", "C"), ("t1", "R", "B", "D"), ("t1", "R", "D", "E")], EDGES)
    pairs = spark.createDataFrame([("t0", "A", "C"), ("t0", "A", "D"), ("t1", "B", "E")], "model_id string, src string, dst string")
    got = {(r.model_id, r.dst): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("t0", "C"): ["A", "B", "C"], ("t1", "E"): ["B", "D", "E"]}
    nodes = spark.createDataFrame([("t0", "A"), ("t0", "B"), ("t1", "B"), ("t1", "D")], "model_id string, node string")
    assert graph.within_tenant(edges, nodes).count() == 2


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 9])
def test_neighbourhood(spark, depth):
    edges = random_edges(3)
    roots = [("t0", "n00"), ("t1", "n03"), ("t0", "n99")]
    got = graph.neighbourhood(spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, "model_id string, node string"), depth, most=9)
    want = set()
    for m, r in roots:
        near, seen, front = neighbours(edges, m), {r}, {r}
        for _ in range(depth):
            front = {b for a in front for b in near.get(a, ())}
            seen |= front
        want |= {(m, r, n) for n in seen - {r}}
    assert {tuple(r) for r in got.collect()} == want


def test_bounds_are_errors_not_shorter_answers(spark):
    edges, roots = spark.createDataFrame(random_edges(3), EDGES), spark.createDataFrame([("t0", "n00")], "model_id string, node string")
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, roots, 4)
    with pytest.raises(ValueError):
        graph.shortest_paths(edges, roots.selectExpr("model_id", "node AS src", "'n05' AS dst"), 11)


def test_patterns_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("t0", "R", "a", "x"), ("t0", "R", "b", "x"), ("t0", "S", "x", "y"), ("t1", "R", "c", "x")], EDGES)
    nodes = spark.createDataFrame([("t0", n, k) for n, k in (("a", "p"), ("b", "p"), ("x", "q"), ("y", "r"))] + [("t1", "c", "p")], "model_id string, node string, type string")
    rows = graph.match(nodes, edges, [Spot("p"), Hop("R", "both"), Spot("q"), Hop("R", "both"), Spot("p")]).collect()
    assert {(r.n0, r.n1, r.n2) for r in rows} == {("a", "x", "b"), ("b", "x", "a")}
    rows = graph.match(nodes, edges, [Spot("r"), Hop("S", "in"), Spot(), Hop(None, "in"), Spot("p", lambda d: d["node"] != "a")]).collect()
    assert {(r.n0, r.n1, r.n2) for r in rows} == {("y", "x", "b")}


def test_pages_cover_everything_once(spark):
    nodes = spark.createDataFrame(
        [("t0" if i % 3 else "t1", f"n{i}", "item", i, i % 7 == 0, {"s": f'"{i % 2}"'}) for i in range(1, 101)],
        "model_id string, node string, type string, seq bigint, tombstoned boolean, props map<string,string>",
    )
    seen, after = [], 0
    while after is not None:
        rows = read.page(nodes, "t0", "item", after, 10).collect()
        seen += [r.seq for r in rows]
        after = rows[0].next_after if rows else None
    assert seen == [i for i in range(1, 101) if i % 3]
    for wrong in (0, 501):
        with pytest.raises(ValueError):
            read.page(nodes, "t0", "item", 0, wrong)
    assert read.page(nodes, "t0", "item", 0, 501, most=600).count() == 67
    odd = read.filtered_page(nodes, "t0", "item", {"s": "1"}, limit=100).collect()
    assert [r.seq for r in odd] == [i for i in range(1, 101) if i % 3 and i % 2]
    assert read.filtered_page(nodes, "t0", "item", {"gone": "1"}).count() == 0
    assert read.typed_scan(nodes, "t0", "item", False).count() == sum(1 for i in range(1, 101) if i % 3 and i % 7)


def test_reach_counts_distinct_ends(spark):
    edges = spark.createDataFrame([("t0", "R", "0", "1"), ("t0", "R", "0", "2"), ("t0", "R", "1", "3"), ("t0", "R", "2", "3"), ("t0", "R", "3", "0")], EDGES)
    root = spark.createDataFrame([("t0", "0")], "model_id string, node string")
    assert {r.node for r in graph.reach(edges, root, 2).collect()} == {"3"}
    assert graph.reach(edges, root, 2).agg(F.count("*")).first()[0] == 1


def test_an_edge_meets_its_far_spot_before_the_paths(spark):
    nodes = spark.createDataFrame([("t0", f"{k}{i}", k) for k in "ab" for i in range(3)] + [("t0", "hub", "h")], "model_id string, node string, type string")
    edges = spark.createDataFrame([("t0", "R", f"{k}{i}", "hub") for k in "ab" for i in range(3)], EDGES)
    found = graph.match(nodes, edges, [Spot("a"), Hop("R", "both"), Spot("h"), Hop("R", "both"), Spot("a")])
    assert {(r.n0, r.n2) for r in found.collect()} == {(f"a{i}", f"a{j}") for i in range(3) for j in range(3) if i != j}
    plan = found._jdf.queryExecution().analyzed()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "Join Inner" in plan.children().last().toString()


def test_distinct_rows_are_dealt_by_their_number(spark):
    """Neither what comes in nor the session's partitions decide how many rows a task makes distinct."""
    from graphlog.storage import distinct_rows

    rows = spark.range(0, 6000, 1, 1).select((F.col("id") % 3000).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    for made in (distinct_rows(rows, rows=100), distinct_rows(rows, 6000, rows=100)):
        assert made.rdd.getNumPartitions() == 60
        assert max(made.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 150
        assert sorted(made.collect(), key=str) == sorted(rows.distinct().collect(), key=str)
    hop = graph.reach(spark.createDataFrame(random_edges(3), EDGES), spark.createDataFrame([("t0", "n00")], "model_id string, node string"), 1)
    plan = hop._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Join" not in plan  # dealt from what was written


def test_levels_hold_a_node_once_for_many_ends(spark, monkeypatch):
    """70 sources and 10 targets meet at 40 nodes: 28,000 meetings, of which no table is made."""
    edges = [("t0", "R", f"s{i:02}", f"m{k:02}") for i in range(70) for k in range(40)]
    edges += [("t0", "R", f"m{k:02}", f"t{j}") for j in range(10) for k in range(40)]
    pairs = [("t0", f"s{i:02}", f"t{j}") for i in range(70) for j in range(10)]
    written, keep = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(out := keep(df)) or out)
    found = graph.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "model_id string, src string, dst string"))
    assert {(r.src, r.dst): r.path for r in found.collect()} == {(s, t): [s, "m00", t] for _, s, t in pairs}
    assert max(df.count() for df in written) <= 2 * len(edges)
