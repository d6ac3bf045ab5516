"""Scans, pages, counts, neighbourhoods, patterns and shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.functions.literals import unquote
from graphlog.operators import graph, read
from graphlog.operators.graph import Hop, Spot
from graphlog.sources import layout
from graphlog.storage import distinct_rows
from workload.fixtures import SQL_EDGES, SQL_NODES, edges, mutations, nodes, table
from workload.registry import SQL, query


@query(
    "typed_scan",
    """SELECT concat('customer:', c_custkey) AS node, c_name AS name, c_acctbal AS balance FROM customer
       WHERE c_custkey % 2 = 1 AND c_mktsegment <> 'MACHINERY'""",
)
def typed_scan(spark, folder):
    rows = read.typed_scan(nodes(spark, folder), "t1", "customer", include_tombstoned=False)
    return rows.select(
        "node", unquote(F.col("props")["name"]).alias("name"), F.col("props")["balance"].cast("double").alias("balance")
    )


@query("point_lookup", "SELECT concat('order:', o_orderkey) AS node, o_orderstatus AS status FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, folder):
    row = read.lookup(nodes(spark, folder), "t0", "order:42")
    return row.select("node", unquote(F.col("props")["status"]).alias("status"))


@query(
    "many_lookup",
    "WITH" + SQL_NODES + """SELECT n.model_id, n.node, n.name FROM nod n WHERE n.type = 'part' AND EXISTS
      (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND concat('part:', l.l_partkey) = n.node)""",
)
def many_lookup(spark, folder):
    keys = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("model_id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node"),
    )
    found = read.lookup_many(nodes(spark, folder), keys)
    return found.select("model_id", "node", unquote(F.col("props")["name"]).alias("name"))


@query(
    "keyset_page",
    """SELECT concat('order:', o_orderkey) AS node, o_orderkey AS seq, 1000 + 2 * 50 AS next_after FROM orders
       WHERE o_orderkey % 2 = 0 AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50""",
)
def keyset_page(spark, folder):
    return read.page(nodes(spark, folder), "t0", "order", after=1000).select("node", "seq", "next_after")


@query(
    "filtered_page",
    """SELECT concat('customer:', c_custkey) AS node, c_custkey AS seq FROM customer
       WHERE c_custkey % 2 = 0 AND c_custkey > 10 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20""",
)
def filtered_page(spark, folder):
    return read.filtered_page(nodes(spark, folder), "t0", "customer", {"segment": "BUILDING"}, after=10).select("node", "seq")


@query("label_counts", "WITH" + SQL_NODES + "SELECT model_id, type, count(*) AS n FROM nod GROUP BY model_id, type")
def label_counts(spark, folder):
    return read.count_by_type(nodes(spark, folder))


@query("edge_label_counts", "WITH" + SQL_EDGES + "SELECT 't0' AS model_id, label, count(*) AS n FROM edg GROUP BY label")
def edge_label_counts(spark, folder):
    return read.count_by_label(edges(spark, folder))


@query(
    "first_by_property",
    "SELECT concat('customer:', c_custkey) AS node, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, node LIMIT 10",
)
def first_by_property(spark, folder):
    rows = nodes(spark, folder, only=["customer"]).select("node", F.col("props")["balance"].cast("double").alias("balance"))
    return read.first_by(rows, [F.desc("balance"), F.col("node")], 10)


def _ring(spark, folder):
    """Orders as a ring-like graph: four edges from i to (31 i + k) mod N."""
    keys = table(spark, folder, "orders").select("o_orderkey")
    rows = keys.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    rows = rows.withColumn("to", (F.col("o_orderkey") * 31 + F.col("k")) % keys.count()).filter("to <> o_orderkey")
    return rows.select(
        F.lit("t0").alias("model_id"), F.lit("RELATES").alias("label"),
        F.col("o_orderkey").cast("string").alias("src"), F.col("to").cast("string").alias("dst"),
    )


SQL_RING = """ring AS (SELECT CAST(o_orderkey AS VARCHAR) AS src, CAST((o_orderkey * 31 + k) % (SELECT count(*) FROM orders) AS VARCHAR) AS dst
  FROM orders CROSS JOIN range(4) AS r(k) WHERE (o_orderkey * 31 + k) % (SELECT count(*) FROM orders) <> o_orderkey)
"""


@query(
    "two_hop_reach",
    "WITH" + " " + SQL_RING + "SELECT count(DISTINCT b.dst) AS reached FROM ring a JOIN ring b ON a.dst = b.src WHERE a.src = '0'",
)
def two_hop_reach(spark, folder):
    root = spark.sql("SELECT 't0' AS model_id, '0' AS node")
    return graph.reach(_ring(spark, folder), root, 2).agg(F.count(F.lit(1)).alias("reached"))


@query(
    "two_hop_reach_all",
    "WITH" + SQL_EDGES + """SELECT a.dst AS root, count(DISTINCT b.src) AS reached FROM edg a JOIN edg b ON a.src = b.dst
      WHERE a.label IN ('IN_REGION', 'IN_NATION') GROUP BY a.dst""",
)
def two_hop_reach_all(spark, folder):
    roots = nodes(spark, folder, tenants=1, only=["nation", "region"])
    found = graph.reach(edges(spark, folder), roots, 2, "in")
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("reached"))


@query(
    "neighbourhood",
    "WITH" + SQL_EDGES + """, one AS (SELECT DISTINCT a AS root, b AS node FROM both_ways WHERE a LIKE 'nation:%'),
     two AS (SELECT DISTINCT o.root, w.b AS node FROM one o JOIN both_ways w ON o.node = w.a)
     SELECT root, node FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE root <> node""",
)
def neighbourhood(spark, folder):
    roots = nodes(spark, folder, tenants=1, only=["nation"])
    return graph.neighbourhood(edges(spark, folder), roots, 2).select("root", "node")


@query(
    "neighbourhood_depth_one",
    "WITH" + SQL_EDGES + """SELECT DISTINCT a AS root, b AS node FROM both_ways WHERE a <> b AND (a LIKE 'supplier:%' OR a LIKE 'customer:%')""",
)
def neighbourhood_depth_one(spark, folder):
    roots = nodes(spark, folder, tenants=1, only=["supplier", "customer"])
    return graph.neighbourhood(edges(spark, folder), roots).select("root", "node")


@query(
    "pattern_match",
    """SELECT concat('region:', r_regionkey) AS n0, concat('nation:', n_nationkey) AS n1, concat('customer:', c_custkey) AS n2,
       concat('order:', o_orderkey) AS n3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F' AND c_acctbal > 5000""",
)
def pattern_match(spark, folder):
    def prop(name):
        return lambda df: unquote(df["props"][name])

    found = graph.match(
        nodes(spark, folder, tenants=1),
        edges(spark, folder),
        [
            Spot("region", lambda df: prop("name")(df) == "ASIA"), Hop("IN_REGION", "in"),
            Spot("nation"), Hop("IN_NATION", "in"),
            Spot("customer", lambda df: prop("vip")(df) == "true"), Hop("PLACED_BY", "in"),
            Spot("order", lambda df: prop("status")(df) == "F"),
        ],
    )
    return found.drop("model_id")


@query(
    "pattern_both_ways",
    "WITH" + SQL_EDGES + """, sn AS (SELECT src, dst FROM edg WHERE label = 'IN_NATION' AND src LIKE 'supplier:%')
     SELECT a.src AS n0, a.dst AS n1, b.src AS n2 FROM sn a JOIN sn b ON a.dst = b.dst AND a.src <> b.src""",
)
def pattern_both_ways(spark, folder):
    found = graph.match(
        nodes(spark, folder, tenants=1), edges(spark, folder),
        [Spot("supplier"), Hop("IN_NATION", "both"), Spot("nation"), Hop("IN_NATION", "both"), Spot("supplier")],
    )
    return found.drop("model_id")


@query(
    "within_tenant",
    """SELECT 'PLACED_BY' AS label, concat('t', o_orderkey % 2) AS model_id, count(*) AS n FROM orders
       WHERE o_orderkey % 2 = o_custkey % 2 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey % 2""",
)
def within_tenant(spark, folder):
    tenant = F.concat(F.lit("t"), (F.split("src", ":")[1].cast("long") % 2).cast("string"))
    owned = edges(spark, folder, only=["PLACED_BY"]).withColumn("model_id", tenant)
    return read.count_by_label(graph.within_tenant(owned, nodes(spark, folder)))


SQL_PATHS = (
    SQL_EDGES
    + """,
 walk AS (
  SELECT n.src AS root, n.src AS node, 0 AS hop FROM (SELECT DISTINCT a AS src FROM both_ways WHERE a LIKE 'nation:%') n
  UNION
  SELECT w.root, b.b, w.hop + 1 FROM walk w JOIN both_ways b ON b.a = w.node WHERE w.hop < 5),
 dist AS (SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node),
 parents AS (SELECT d.root, d.node, d.hop, min(b.a) AS parent FROM dist d JOIN both_ways b ON b.b = d.node
   JOIN dist p ON p.root = d.root AND p.node = b.a AND p.hop = d.hop - 1 GROUP BY d.root, d.node, d.hop),
 trail AS (
  SELECT root AS src, node AS dst, hop AS length, node, hop, node AS path FROM dist WHERE node LIKE 'region:%'
  UNION ALL
  SELECT t.src, t.dst, t.length, p.parent, t.hop - 1, concat(p.parent, '>', t.path) FROM trail t
   JOIN parents p ON p.root = t.src AND p.node = t.node WHERE t.hop > 0)
"""
)


@query("shortest_path", "WITH RECURSIVE" + SQL_PATHS + "SELECT src, dst, length, path FROM trail WHERE hop = 0")
def shortest_path(spark, folder):
    ends = nodes(spark, folder, tenants=1, only=["nation", "region"])
    sources = ends.filter("type = 'nation'").select("model_id", F.col("node").alias("src"))
    targets = ends.filter("type = 'region'").select("model_id", F.col("node").alias("dst"))
    pairs = sources.join(F.broadcast(targets), "model_id")
    found = graph.shortest_paths(edges(spark, folder), pairs)
    return found.select("src", "dst", "length", F.array_join("path", ">").alias("path"))


@query(
    "dead_letter_listing",
    """SELECT event_id, concat('c', event_id % 4) AS connector_id FROM events WHERE event_type = 'error' AND event_id % 4 = 2
       ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def dead_letter_listing(spark, folder):
    log = table(spark, folder, "events").withColumn("connector_id", F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")))
    where = (F.col("event_type") == "error") & (F.col("connector_id") == "c2")
    return read.newest(log, "ts", "event_id", where=where).select("event_id", "connector_id")


@query(
    "audit_listing",
    """SELECT event_id AS call_id, event_type AS agent_id FROM events WHERE user_id % 3 = 1 AND event_type = 'click'
       AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def audit_listing(spark, folder):
    calls = mutations(spark, folder).select(
        "model_id", F.col("seq").alias("call_id"), F.col("source_system").alias("agent_id"), F.col("event_time").alias("called_at")
    )
    span = [F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-25 00:00:00")]
    return read.audit_listing(calls, "t1", "click", *span).select("call_id", "agent_id")


# the same reads from the stored layouts


@query("stored_lookup", SQL["point_lookup"])
def stored_lookup(spark, folder):
    row = layout.NodeStore.write(nodes(spark, folder)).lookup("t0", "order:42")
    return row.select("node", unquote(F.col("props")["status"]).alias("status"))


@query("stored_many_lookup", SQL["many_lookup"])
def stored_many_lookup(spark, folder):
    keys = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("model_id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node"),
    )
    found = layout.NodeStore.write(nodes(spark, folder), rows_per_file=20_000).lookup_many(keys)
    return found.select("model_id", "node", unquote(F.col("props")["name"]).alias("name"))


@query("stored_page", SQL["keyset_page"])
def stored_page(spark, folder):
    store = layout.NodeStore.write(nodes(spark, folder), rows_per_file=20_000)
    return store.page("t0", "order", after=1000).select("node", "seq", "next_after")


@query("stored_filtered_page", SQL["filtered_page"])
def stored_filtered_page(spark, folder):
    store = layout.NodeStore.write(nodes(spark, folder), rows_per_file=20_000)
    return store.filtered_page("t0", "customer", {"segment": "BUILDING"}, after=10).select("node", "seq")


@query("stored_two_hop_reach_all", SQL["two_hop_reach_all"])
def stored_two_hop_reach_all(spark, folder):
    roots = nodes(spark, folder, tenants=1, only=["nation", "region"])
    step = layout.stored_steps(distinct_rows(graph.steps(edges(spark, folder), "in")))
    found = graph.reach(None, roots, 2, step=step)
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("reached"))


@query("stored_neighbourhood", SQL["neighbourhood"])
def stored_neighbourhood(spark, folder):
    roots = nodes(spark, folder, tenants=1, only=["nation"])
    step = layout.stored_steps(distinct_rows(graph.steps(edges(spark, folder))))
    return graph.neighbourhood(None, roots, 2, step=step).select("root", "node")
