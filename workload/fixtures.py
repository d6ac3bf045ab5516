"""The given tables seen as a change log, a graph and registries.

Each builder has a twin in ``SQL_*`` below: the same rows as a common table
expression for the SQL side of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.functions.literals import quote
from graphlog.operators.log import event_type, histories
from graphlog.storage import distinct_rows

STATE_KEYS = ["value", "k"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def at(text: str):
    return F.lit(text).cast("timestamp")


def mutations(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a mutation of its user's node.

    A user's first event creates the node, some errors tombstone it, the rest
    update it; every third update carries ``value`` only. Tombstones carry a
    payload that must not count, some updates a key the log owns, and some a
    property that ``STATE_KEYS`` does not list.
    """
    ev = table(spark, folder, "events")
    first = ev.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    op = (
        F.when(F.col("event_id") == F.col("first_id"), "CREATE")
        .when((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0), "TOMBSTONE")
        .otherwise("UPDATE")
    )
    rows = ev.join(first, "user_id").withColumn("operation", op)
    k = F.regexp_extract("props", "[0-9]+", 0)
    full = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), k)
    part = F.create_map(F.lit("value"), F.col("value").cast("string"))
    stray = F.create_map(F.lit("_created_at"), F.lit('"1970-01-01"'), F.lit("extra"), (F.col("event_id") % 100).cast("string"))
    body = F.when((F.col("operation") == "UPDATE") & (F.col("event_id") % 3 == 0), part).otherwise(full)
    payload = (
        F.when(F.col("operation") == "TOMBSTONE", F.create_map(F.lit("value"), F.lit("-1")))
        .when((F.col("operation") == "UPDATE") & (F.col("event_id") % 11 == 0), F.map_concat(body, stray))
        .otherwise(body)
    )
    return rows.select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "operation",
        F.lit("user").alias("type"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("node"),
        payload.alias("payload"),
        F.lit("STRUCTURED").alias("source_type"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("source_system"),
        F.lit(1).cast("decimal(4,3)").alias("confidence"),
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("origin_connector_id"),
        F.concat(F.lit("x"), (F.col("event_id") % 2500).cast("string")).alias("origin_change_id"),
    )


SQL_MUTATIONS = """
mut AS (
  SELECT *, CASE WHEN op = 'TOMBSTONE' THEN NULL ELSE raw_value END AS value, CASE WHEN op = 'TOMBSTONE' THEN '-1' ELSE raw_value END AS sent,
         CASE WHEN op = 'TOMBSTONE' OR (op = 'UPDATE' AND seq % 3 = 0) THEN NULL ELSE raw_k END AS k,
         CASE WHEN op = 'UPDATE' AND seq % 11 = 0 THEN CAST(seq % 100 AS VARCHAR) END AS extra
  FROM (
    SELECT concat('t', user_id % 3) AS model_id, event_id AS seq, ts AS event_time,
           concat('user:', user_id) AS node, event_type AS source_system,
           concat('s', event_id) AS source_id,
           concat('c', event_id % 4) AS conn, concat('x', event_id % 2500) AS change,
           CAST(value AS VARCHAR) AS raw_value, regexp_extract(props, '[0-9]+') AS raw_k,
           CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'CREATE'
                WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'TOMBSTONE' ELSE 'UPDATE' END AS op
    FROM events))
"""

SQL_HISTORY = (
    SQL_MUTATIONS
    + """,
hist AS (
  SELECT model_id, node, seq, event_time, op, source_system, source_id, conn, change,
         last_value(value IGNORE NULLS) OVER w AS value, last_value(k IGNORE NULLS) OVER w AS k,
         last_value(extra IGNORE NULLS) OVER w AS extra, bool_or(op = 'TOMBSTONE') OVER w AS gone
  FROM mut WINDOW w AS (PARTITION BY model_id, node ORDER BY seq ROWS UNBOUNDED PRECEDING)),
evt AS (
  SELECT *, concat('{', concat_ws(',', CASE WHEN gone THEN '"_tombstoned":true' END, '"extra":' || extra, '"k":' || k, '"value":' || value), '}') AS json,
         concat(op, '_NODE') AS event_type FROM hist)
"""
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log of ``mutations``: full state after each one."""
    log = histories(mutations(spark, folder), STATE_KEYS)
    return log.withColumn("event_type", event_type()).withColumn("event_id", F.concat_ws(":", "model_id", "seq"))


def nodes(spark: SparkSession, folder: str, tenants: int = 2, only: list[str] | None = None) -> DataFrame:
    """Customers, suppliers, parts, orders, nations and regions as nodes."""
    def one(name: str, kind: str, key: str, props: dict[str, object], gone) -> DataFrame:
        pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
        return table(spark, folder, name).select(
            F.concat(F.lit("t"), (F.col(key) % tenants).cast("string")).alias("model_id"),
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node"),
            F.lit(kind).alias("type"),
            at("2024-01-01 00:00:00").alias("created_at"),
            at("2024-01-02 00:00:00").alias("updated_at"),
            F.lit("load").alias("created_by"),
            F.lit(name).alias("source"),
            F.lit("load").alias("source_id"),
            gone.alias("tombstoned"),
            F.when(gone, at("2024-01-02 00:00:00")).alias("tombstoned_at"),
            F.col(key).cast("long").alias("seq"),
            F.create_map(*pairs).alias("props"),
        )

    never = F.lit(False)
    spec = {
        "customer": ("customer", "c_custkey", {
            "name": quote(F.col("c_name")), "segment": quote(F.col("c_mktsegment")),
            "nation": quote(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))),
            "balance": F.col("c_acctbal").cast("string"), "vip": (F.col("c_acctbal") > 5000).cast("string"),
        }, F.col("c_mktsegment") == "MACHINERY"),
        "supplier": ("supplier", "s_suppkey", {"name": quote(F.col("s_name")), "balance": F.col("s_acctbal").cast("string")}, never),
        "part": ("part", "p_partkey", {
            "name": quote(F.concat_ws(" ", "p_name", "p_brand")), "size": F.col("p_size").cast("string"),
            "kind": quote(F.col("p_type")),
        }, never),
        "order": ("orders", "o_orderkey", {"name": quote(F.col("o_orderkey").cast("string")), "status": quote(F.col("o_orderstatus"))}, never),
        "nation": ("nation", "n_nationkey", {"name": quote(F.col("n_name"))}, never),
        "region": ("region", "r_regionkey", {"name": quote(F.col("r_name"))}, never),
    }
    out = None
    for kind in only or list(spec):
        name, key, props, gone = spec[kind]
        part = one(name, kind, key, props, gone)
        out = part if out is None else out.unionByName(part)
    return out


SQL_NODES = """
nod AS (
  SELECT concat('t', c_custkey % 2) AS model_id, concat('customer:', c_custkey) AS node, 'customer' AS type,
         CAST(c_custkey AS BIGINT) AS seq, c_name AS name, c_mktsegment = 'MACHINERY' AS tombstoned FROM customer
  UNION ALL SELECT concat('t', s_suppkey % 2), concat('supplier:', s_suppkey), 'supplier', s_suppkey, s_name, false FROM supplier
  UNION ALL SELECT concat('t', p_partkey % 2), concat('part:', p_partkey), 'part', p_partkey, concat_ws(' ', p_name, p_brand), false FROM part
  UNION ALL SELECT concat('t', o_orderkey % 2), concat('order:', o_orderkey), 'order', o_orderkey, CAST(o_orderkey AS VARCHAR), false FROM orders
  UNION ALL SELECT concat('t', n_nationkey % 2), concat('nation:', n_nationkey), 'nation', n_nationkey, n_name, false FROM nation
  UNION ALL SELECT concat('t', r_regionkey % 2), concat('region:', r_regionkey), 'region', r_regionkey, r_name, false FROM region)
"""


def edges(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """Foreign keys as edges of one tenant."""
    def one(df: DataFrame, label: str, src_type: str, src: str, dst_type: str, dst: str) -> DataFrame:
        return df.select(
            F.lit("t0").alias("model_id"),
            F.lit(label).alias("label"),
            F.concat(F.lit(f"{src_type}:"), F.col(src).cast("string")).alias("src"),
            F.concat(F.lit(f"{dst_type}:"), F.col(dst).cast("string")).alias("dst"),
            F.lit(src_type).alias("src_type"),
            F.lit(dst_type).alias("dst_type"),
        )

    def t(name: str) -> DataFrame:
        return table(spark, folder, name)

    spec = {
        "PLACED_BY": lambda: one(t("orders"), "PLACED_BY", "order", "o_orderkey", "customer", "o_custkey"),
        "IN_NATION": lambda: one(t("customer"), "IN_NATION", "customer", "c_custkey", "nation", "c_nationkey").unionByName(
            one(t("supplier"), "IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey")
        ),
        "IN_REGION": lambda: one(t("nation"), "IN_REGION", "nation", "n_nationkey", "region", "n_regionkey"),
        "SUPPLIED_BY": lambda: one(
            distinct_rows(t("lineitem").select("l_partkey", "l_suppkey"), t("lineitem").count()), "SUPPLIED_BY", "part", "l_partkey", "supplier", "l_suppkey"
        ),
    }
    out = None
    for label in only or list(spec):
        part = spec[label]()
        out = part if out is None else out.unionByName(part)
    return out


SQL_EDGES = """
edg AS (
  SELECT 'PLACED_BY' AS label, concat('order:', o_orderkey) AS src, concat('customer:', o_custkey) AS dst FROM orders
  UNION ALL SELECT 'IN_NATION', concat('customer:', c_custkey), concat('nation:', c_nationkey) FROM customer
  UNION ALL SELECT 'IN_NATION', concat('supplier:', s_suppkey), concat('nation:', s_nationkey) FROM supplier
  UNION ALL SELECT 'IN_REGION', concat('nation:', n_nationkey), concat('region:', n_regionkey) FROM nation
  UNION ALL SELECT 'SUPPLIED_BY', concat('part:', p), concat('supplier:', s)
    FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)),
both_ways AS (SELECT src AS a, dst AS b FROM edg UNION SELECT dst, src FROM edg)
"""


def state_columns(df: DataFrame, name: str = "payload") -> list:
    return [F.col(name)[k].alias(k) for k in STATE_KEYS]
