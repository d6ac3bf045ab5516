"""Typed views, the schema registry, access control and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.functions.literals import unquote
from graphlog.operators import access, reconcile, registry, report
from graphlog.plans import views
from workload.fixtures import SQL_MUTATIONS, at, mutations, nodes, table
from workload.registry import query
from workload.rule_queries import SQL_AUTHORITY, SQL_CONFLICT, _authority


def _customer_registry(spark):
    return spark.sql(
        "SELECT 't0' AS model_id, 'customer' AS type, p AS property, d AS data_type, r AS required, CAST(x AS TIMESTAMP) AS deprecated_at,"
        " rr AS read_roles, wr AS write_roles FROM VALUES"
        " ('name','STRING',true,NULL,array(),array()), ('segment','STRING',false,NULL,array('SALES','ADMIN'),array('ADMIN')),"
        " ('balance','INTEGER',false,NULL,array('ADMIN'),array('SALES')), ('vip','BOOLEAN',false,NULL,array(),array()),"
        " ('nation','REFERENCE',false,TIMESTAMP'2024-01-01 00:00:00',array(),array()) AS c(p, d, r, x, rr, wr)"
    )


@query(
    "typed_view",
    """SELECT concat('customer:', c_custkey) AS node, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_acctbal > 5000 AS vip
       FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'""",
)
def typed_view(spark, folder):
    everyone = nodes(spark, folder, only=["customer"])
    columns = [(n, "double" if n == "balance" else kind) for n, kind in views.type_columns(_customer_registry(spark), "t0", "customer")]
    return views.typed_view(everyone, columns, "t0", "customer").select("node", "name", "segment", "balance", "vip")


@query(
    "typed_view_casts",
    """SELECT concat('order:', o_orderkey) AS node, CAST(o_orderkey AS INTEGER) AS name, CASE WHEN o_orderstatus = 'F' THEN false END AS status
       FROM orders WHERE o_orderkey % 2 = 1""",
)
def typed_view_casts(spark, folder):
    found = views.typed_view(nodes(spark, folder, only=["order"]), [("name", "INTEGER"), ("status", "BOOLEAN")], "t1", "order")
    return found.select("node", "name", "status")


@query(
    "view_refresh",
    """SELECT c_mktsegment AS segment, count(*) AS n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS vips FROM customer
       WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY' GROUP BY 1""",
)
def view_refresh(spark, folder):
    types = spark.sql("SELECT 't0' AS model_id, 'customer' AS type, true AS exposed, 3L AS schema_version")
    name = views.view_name("t0", "customer")
    views.refresh_views(spark, nodes(spark, folder, only=["customer"]), types, _customer_registry(spark), {name: 2})
    return spark.sql(f"SELECT segment, count(*) AS n, sum(CASE WHEN vip THEN 1 ELSE 0 END) AS vips FROM {name} GROUP BY segment")


def _changes(spark, folder):
    """Each event as a schema change: most add a property, some take one away."""
    kind = F.when(F.col("event_type") == "purchase", "DEPRECATE_PROPERTY").when(F.col("event_type") == "error", "REMOVE_PROPERTY")
    return table(spark, folder, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.col("event_id").alias("change_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("type"), (F.col("user_id") % 5).cast("string")).alias("type"),
        F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string")).alias("property"),
        kind.otherwise("ADD_PROPERTY").alias("change_type"),
    )


SQL_VERSIONS = """changes AS (SELECT concat('t', user_id % 3) AS model_id, event_id AS change_id, concat('type', user_id % 5) AS type,
  concat('p', event_id % 40) AS property, CASE event_type WHEN 'purchase' THEN 'DEPRECATE_PROPERTY' WHEN 'error' THEN 'REMOVE_PROPERTY' ELSE 'ADD_PROPERTY' END AS change_type,
  row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS version FROM events),
d1 AS (SELECT model_id, type, property, max(version) AS since FROM changes WHERE version <= 1000 GROUP BY ALL HAVING max_by(change_type, version) = 'ADD_PROPERTY'),
d2 AS (SELECT model_id, type, property, max(version) AS since FROM changes WHERE version <= 1500 GROUP BY ALL HAVING max_by(change_type, version) = 'ADD_PROPERTY')
"""


@query("schema_versions", "WITH " + SQL_VERSIONS + "SELECT model_id, change_id, version FROM changes")
def schema_versions(spark, folder):
    return registry.versions(_changes(spark, folder)).select("model_id", "change_id", "version")


@query("schema_current_version", "WITH " + SQL_VERSIONS + "SELECT model_id, max(version) AS version FROM changes GROUP BY model_id")
def schema_current_version(spark, folder):
    return registry.current_version(registry.versions(_changes(spark, folder)))


@query("descriptor_at_version", "WITH " + SQL_VERSIONS + "SELECT * FROM d1")
def descriptor_at_version(spark, folder):
    return registry.descriptor_at(registry.versions(_changes(spark, folder)), 1000)


@query(
    "net_property_counts",
    "WITH " + SQL_VERSIONS + """SELECT model_id, type, CAST(sum(CASE WHEN change_type = 'ADD_PROPERTY' THEN 1 ELSE -1 END) AS BIGINT) AS net
      FROM changes WHERE version <= 1000 GROUP BY model_id, type""",
)
def net_property_counts(spark, folder):
    return registry.net_property_counts(registry.versions(_changes(spark, folder)), 1000)


@query(
    "breaking_changes",
    "WITH " + SQL_VERSIONS + """SELECT model_id, type, property, false AS allowed FROM d1 ANTI JOIN d2 USING (model_id, type, property)
      WHERE CAST(substr(property, 2) AS INTEGER) % 2 = 0""",
)
def breaking_changes(spark, folder):
    versioned = registry.versions(_changes(spark, folder))
    needed = F.substring("property", 2, 9).cast("int") % 2 == 0
    before = registry.descriptor_at(versioned, 1000).withColumn("required", needed)
    return registry.breaking_changes(before, registry.descriptor_at(versioned, 1500))


def _aliases(spark, folder):
    """Old property names of customers, renamed by each nation in turn."""
    return table(spark, folder, "nation").select(
        F.concat(F.lit("t"), (F.col("n_nationkey") % 2).cast("string")).alias("model_id"), F.lit("customer").alias("type"),
        F.when(F.col("n_regionkey") < 3, "segment").otherwise("balance").alias("old_slug"),
        F.lower("n_name").alias("current_slug"), F.col("n_nationkey").alias("changed_at"),
    )


SQL_ALIASES = """alias AS (SELECT concat('t', n_nationkey % 2) AS model_id, CASE WHEN n_regionkey < 3 THEN 'segment' ELSE 'balance' END AS old_slug,
  max_by(lower(n_name), n_nationkey) AS current_slug FROM nation GROUP BY 1, 2)
"""


@query(
    "alias_resolution",
    "WITH " + SQL_ALIASES + """, props AS (SELECT c_custkey, concat('t', c_custkey % 2) AS model_id, unnest(['name', 'segment', 'balance', 'vip', 'nation']) AS property FROM customer)
     SELECT p.c_custkey, coalesce(a.current_slug, p.property) AS property FROM props p LEFT JOIN alias a ON a.model_id = p.model_id AND a.old_slug = p.property""",
)
def alias_resolution(spark, folder):
    held = nodes(spark, folder, only=["customer"]).select("model_id", "type", F.col("seq").alias("c_custkey"), F.explode(F.map_keys("props")).alias("property"))
    return registry.resolve_alias(held, _aliases(spark, folder)).select("c_custkey", "property")


@query(
    "alias_payload",
    "WITH " + SQL_ALIASES + """SELECT c_custkey, (SELECT current_slug FROM alias WHERE model_id = concat('t', c_custkey % 2) AND old_slug = 'segment') AS new_name,
      c_mktsegment AS segment, 5 AS size FROM customer""",
)
def alias_payload(spark, folder):
    rows = nodes(spark, folder, only=["customer"])
    renamed = registry.rename_properties(rows, _aliases(spark, folder), "props").select("node", F.col("props").alias("new"), F.col("seq").alias("c_custkey"))
    value = unquote(F.map_values(F.map_filter("new", lambda k, v: v.rlike("^\"[A-Z]+\"$")))[0])
    name = F.map_keys(F.map_filter("new", lambda k, v: v.rlike("^\"[A-Z]+\"$")))[0]
    return renamed.select("c_custkey", name.alias("new_name"), value.alias("segment"), F.size("new").alias("size"))


def _types(spark, folder):
    """Node types and their readers, from the change log."""
    rows = _changes(spark, folder).groupBy("model_id", "type").agg(F.max("change_id").alias("last"), F.count(F.lit(1)).alias("schema_version"))
    roles = F.when(F.col("last") % 3 == 0, F.array(F.lit("ADMIN"))).when(F.col("last") % 3 == 1, F.array(F.lit("SALES"), F.lit("ADMIN")))
    return rows.select(
        "model_id", "type", F.initcap("type").alias("name"), F.concat(F.lit("about "), "type").alias("description"), "schema_version",
        (F.col("last") % 2 == 0).alias("exposed"), roles.alias("read_roles"),
    )


SQL_TYPES = """types AS (SELECT concat('t', user_id % 3) AS model_id, concat('type', user_id % 5) AS type, max(event_id) AS last, count(*) AS schema_version FROM events GROUP BY ALL),
props AS (SELECT DISTINCT concat('t', user_id % 3) AS model_id, concat('type', user_id % 5) AS type, concat('p', event_id % 40) AS property,
   CASE WHEN event_id % 40 % 5 = 0 THEN 'REFERENCE' ELSE 'STRING' END AS data_type, concat('type', event_id % 40 % 7) AS target FROM events)
"""


@query("list_types", "WITH " + SQL_TYPES + "SELECT model_id, type, concat('about ', type) AS description, schema_version FROM types WHERE last % 3 <> 0")
def list_types(spark, folder):
    found = registry.list_types(_types(spark, folder), access.open_to(F.col("read_roles"), ["SALES"]))
    return found.select("model_id", "type", "description", "schema_version")


@query("exposed_types", "WITH " + SQL_TYPES + "SELECT model_id, type FROM types WHERE last % 2 = 0")
def exposed_types(spark, folder):
    return registry.exposed_types(_types(spark, folder)).select("model_id", "type")


@query("exposed_tenants", "WITH " + SQL_TYPES + "SELECT DISTINCT model_id FROM types WHERE last % 2 = 0")
def exposed_tenants(spark, folder):
    return registry.exposed_tenants(_types(spark, folder))


def _properties(spark, folder):
    n = F.substring("property", 2, 9).cast("int")
    return _changes(spark, folder).select("model_id", "type", "property").distinct().select(
        "*", F.when(n % 5 == 0, "Reference").otherwise("string").alias("data_type"), (n % 2 == 0).alias("required"),
        F.concat(F.lit("type"), (n % 7).cast("string")).alias("reference_target"),
        F.when(n % 4 == 0, at("2024-01-01 00:00:00")).alias("deprecated_at"),
    )


@query("live_properties", "WITH " + SQL_TYPES + "SELECT model_id, type, property FROM props WHERE CAST(substr(property, 2) AS INTEGER) % 4 <> 0")
def live_properties(spark, folder):
    return registry.live_properties(_properties(spark, folder)).select("model_id", "type", "property")


@query(
    "describe_types",
    "WITH " + SQL_TYPES + """, refs AS (SELECT model_id, type AS s, target AS t, property AS via FROM props WHERE data_type = 'REFERENCE'),
  touching AS (SELECT model_id, s AS type, s, t, via FROM refs UNION SELECT model_id, t, s, t, via FROM refs)
  SELECT y.model_id, y.type, (SELECT count(*) FROM props p WHERE p.model_id = y.model_id AND p.type = y.type) AS properties,
   (SELECT string_agg(concat(s, '-', via, '-', t), ',' ORDER BY s, t, via) FROM touching x WHERE x.model_id = y.model_id AND x.type = y.type) AS edges FROM types y""",
)
def describe_types(spark, folder):
    found = registry.describe_types(_types(spark, folder), _properties(spark, folder))
    edge = F.transform("edge_types", lambda e: F.concat_ws("-", e["source_type"], e["via_property"], e["target_type"]))
    return found.select("model_id", "type", F.size("properties").cast("long").alias("properties"), F.array_join(edge, ",").alias("edges"))


@query(
    "acl_filter",
    """SELECT concat('t', c_custkey % 2) AS model_id, concat('customer:', c_custkey) AS node, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 0 END AS shown FROM customer""",
)
def acl_filter(spark, folder):
    found = access.filter_properties(nodes(spark, folder, only=["customer"]), _customer_registry(spark), ["SALES"])
    p = F.col("props")
    return found.select("model_id", "node", unquote(p["name"]).alias("name"), unquote(p["segment"]).alias("segment"), F.size(p).alias("shown"))


@query("type_visibility", "WITH " + SQL_TYPES + "SELECT model_id, type FROM types WHERE last % 3 = 2")
def type_visibility(spark, folder):
    return access.visible_types(_types(spark, folder), ["GUEST"]).select("model_id", "type")


@query(
    "write_roles",
    """SELECT concat('customer:', c_custkey) AS node, CASE WHEN c_custkey % 2 = 0 THEN 'segment' ELSE '' END AS denied FROM customer""",
)
def write_roles(spark, folder):
    checked = access.check_writes(nodes(spark, folder, only=["customer"]), _customer_registry(spark), ["SALES"], "props")
    return checked.select("node", F.array_join("denied", ",").alias("denied"))


@query(
    "run_metrics",
    "WITH"
    + SQL_MUTATIONS
    + SQL_AUTHORITY
    + ", clash AS ("
    + SQL_CONFLICT.format(owner="creator")
    + """) SELECT m.model_id, count(*) FILTER (WHERE op <> 'TOMBSTONE') AS ingested, count(*) AS evaluated,
     (SELECT count(*) FROM clash c WHERE c.model_id = m.model_id) AS conflicts FROM mut m GROUP BY m.model_id""",
)
def run_metrics(spark, folder):
    m = mutations(spark, folder)
    clashes = reconcile.conflicts(reconcile.settle(m, _authority(spark)))
    return report.run_metrics(m.filter("operation <> 'TOMBSTONE'"), m, clashes)


def _calls(spark, folder):
    return table(spark, folder, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_type").alias("agent_id"),
        F.col("ts").cast("timestamp").alias("called_at"), F.when(F.col("value") > 100, "QUOTA_EXCEEDED").otherwise("OK").alias("outcome"),
    )


@query(
    "agent_calls",
    """SELECT concat('t', user_id % 3) AS model_id, event_type AS agent_id, count(*) AS calls FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND value <= 100 GROUP BY ALL""",
)
def agent_calls(spark, folder):
    return report.calls_since(_calls(spark, folder), at("2024-01-10 00:00:00"))


@query(
    "agent_usage",
    """WITH q(model_id, agent_id, per_hour) AS (VALUES ('t0', 'click', 1), ('t1', 'view', 2), ('t2', 'error', 0)),
     used AS (SELECT concat('t', user_id % 3) AS model_id, event_type AS agent_id, date_trunc('hour', ts) AS h, count(*) AS used FROM events GROUP BY ALL)
     SELECT u.model_id, u.agent_id, epoch_us(h) AS hour, used, coalesce(per_hour, 0) AS allowed, used > coalesce(per_hour, 0) AS exceeded
     FROM used u LEFT JOIN q ON q.model_id = u.model_id AND q.agent_id = u.agent_id""",
)
def agent_usage(spark, folder):
    quotas = spark.sql("SELECT * FROM VALUES ('t0','click',1), ('t1','view',2), ('t2','error',0) AS q(model_id, agent_id, per_hour)")
    return report.clock_hour_usage(_calls(spark, folder), quotas).withColumn("hour", F.unix_micros("hour"))


@query(
    "agent_usage_from_first_call",
    """WITH RECURSIVE q(model_id, agent_id, per_hour) AS (VALUES ('t0', 'click', 1), ('t1', 'view', 2), ('t2', 'error', 0)),
     c AS (SELECT concat('t', user_id % 3) AS model_id, event_type AS agent_id, epoch_us(ts) AS moment, count(*) AS n FROM events GROUP BY ALL),
     j AS (SELECT *, min(moment) OVER (PARTITION BY model_id, agent_id ORDER BY moment RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS further FROM c),
     w AS (SELECT model_id, agent_id, min(moment) AS s FROM c GROUP BY ALL
           UNION ALL SELECT w.model_id, w.agent_id, j.further FROM w JOIN j ON j.model_id = w.model_id AND j.agent_id = w.agent_id AND j.moment = w.s WHERE j.further IS NOT NULL),
     used AS (SELECT c.model_id, c.agent_id, s, CAST(sum(n) AS BIGINT) AS used FROM c ASOF JOIN w ON w.model_id = c.model_id AND w.agent_id = c.agent_id AND c.moment >= w.s GROUP BY ALL)
     SELECT u.model_id, u.agent_id, s AS opened_at, used, coalesce(per_hour, 0) AS allowed, used > coalesce(per_hour, 0) AS exceeded
     FROM used u LEFT JOIN q ON q.model_id = u.model_id AND q.agent_id = u.agent_id""",
)
def agent_usage_from_first_call(spark, folder):
    quotas = spark.sql("SELECT * FROM VALUES ('t0','click',1), ('t1','view',2), ('t2','error',0) AS q(model_id, agent_id, per_hour)")
    return report.hourly_usage(_calls(spark, folder), quotas).withColumn("opened_at", F.unix_micros("opened_at"))
