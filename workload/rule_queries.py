"""Rules, reconciliation, shapes and the whole write funnel."""

from __future__ import annotations


from pyspark.sql import functions as F

from graphlog.operators import reconcile, rules, shapes
from graphlog.plans.funnel import run_funnel
from workload.fixtures import SQL_MUTATIONS, STATE_KEYS, mutations, state_columns
from workload.registry import query

SQL_AUTHORITY = """, ruled AS (
  SELECT *, first_value(source_system) OVER (PARTITION BY model_id, node ORDER BY seq) AS creator,
    first_value(source_id) OVER (PARTITION BY model_id, node ORDER BY seq) AS creator_id FROM mut),
writes AS (
  SELECT model_id, node, seq, source_system, source_id, creator, value,
    CASE source_system WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 99 END AS rank,
    CASE creator WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 99 END AS creator_rank
  FROM ruled WHERE value IS NOT NULL AND model_id IN ('t0', 't1')),
firsts AS (SELECT *, row_number() OVER w = 1 AS is_first, first_value(value) OVER w AS first_value FROM writes
  WINDOW w AS (PARTITION BY model_id, node ORDER BY seq)),
judged AS (SELECT *, is_first OR source_system = creator OR rank < creator_rank AS accepted FROM firsts),
settled AS (SELECT *, last_value(CASE WHEN accepted THEN value END IGNORE NULLS) OVER (
    PARTITION BY model_id, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM judged)
"""


def _authority(spark):
    return spark.sql(
        "SELECT t AS model_id, 'user' AS type, 'value' AS property, array('purchase','signup','click') AS priority_order"
        " FROM VALUES ('t0'), ('t1') AS x(t)"
    )


@query(
    "authority_decisions",
    "WITH" + SQL_MUTATIONS + SQL_AUTHORITY + "SELECT model_id, node, seq, value, accepted, current FROM settled",
)
def authority_decisions(spark, folder):
    found = reconcile.settle(mutations(spark, folder), _authority(spark))
    return found.select("model_id", "node", "seq", "value", "accepted", "current")


@query(
    "authority_fold",
    "WITH"
    + SQL_MUTATIONS
    + SQL_AUTHORITY
    + """SELECT model_id, node, 'value' AS property, max_by(value, seq) AS value FROM settled WHERE accepted GROUP BY model_id, node""",
)
def authority_fold(spark, folder):
    return reconcile.settled_values(reconcile.settle(mutations(spark, folder), _authority(spark)))


SQL_CONFLICT = """SELECT model_id, node, seq, 'value' AS property, source_id AS losing_source_id,
  CASE WHEN accepted THEN {owner} ELSE source_system END AS losing_source,
  CASE WHEN accepted THEN current ELSE value END AS losing_value,
  CASE WHEN accepted THEN source_id ELSE '' END AS winning_source_id,
  CASE WHEN accepted THEN source_system ELSE {owner} END AS winning_source,
  CASE WHEN accepted THEN value ELSE current END AS winning_value
FROM settled WHERE current IS NOT NULL AND current <> value AND {owner} <> source_system"""


@query("conflict_register", "WITH" + SQL_MUTATIONS + SQL_AUTHORITY + SQL_CONFLICT.format(owner="creator"))
def conflict_register(spark, folder):
    found = reconcile.conflicts(reconcile.settle(mutations(spark, folder), _authority(spark)))
    return found.drop("type", "rule_id")


@query(
    "conflict_register_last_owner",
    "WITH"
    + SQL_MUTATIONS
    + """, writes AS (
  SELECT model_id, node, seq, source_system, source_id, value,
    CASE source_system WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 99 END AS rank
  FROM mut WHERE value IS NOT NULL AND model_id IN ('t0', 't1')),
best AS (SELECT *, min(rank) OVER w AS best, first_value(source_system) OVER (PARTITION BY model_id, node ORDER BY seq) AS first_source
  FROM writes WINDOW w AS (PARTITION BY model_id, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, best IS NULL OR rank < best OR (rank = best AND (rank < 99 OR source_system = first_source)) AS accepted FROM best),
settled AS (SELECT *, last_value(CASE WHEN accepted THEN value END IGNORE NULLS) OVER w AS current,
    last_value(CASE WHEN accepted THEN source_system END IGNORE NULLS) OVER w AS owner FROM judged
  WINDOW w AS (PARTITION BY model_id, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
    + SQL_CONFLICT.format(owner="owner"),
)
def conflict_register_last_owner(spark, folder):
    found = reconcile.conflicts(reconcile.settle(mutations(spark, folder), _authority(spark), mode="last_owner"))
    return found.drop("type", "rule_id")


def _rules():
    value = F.col("payload")["value"].cast("double")
    k = F.col("payload")["k"].cast("int")
    return [
        rules.Rule("too-large", "VALIDATE", 10, "reject", F.lit("value above 250"), value > 250),
        rules.Rule("odd-source", "VALIDATE", 20, "reject", F.lit("errors may not write"), F.col("source_system") == "error"),
        rules.Rule("cap", "RECONCILE", 5, "merge", F.lit("200"), value > 200, "value"),
        rules.Rule("steady", "RECONCILE", 9, "override", F.lit("1"), k == 7, "k", F.col("source_system"), F.col("payload")["k"]),
        rules.Rule("band", "ENRICH", 50, "add", F.when(value > 100, F.lit('"high"')).otherwise(F.lit('"low"')), value.isNotNull(), "band"),
        rules.Rule("default-k", "ENRICH", 10, "add", F.lit("0"), None, "k"),
        rules.Rule("default-band", "ENRICH", 10, "add", F.lit('"none"'), None, "band"),
        rules.Rule("to-topic", "ROUTE", 10, "route", F.create_map(F.lit("topic"), F.col("source_system"))),
        rules.Rule("to-alerts", "ROUTE", 5, "route", F.create_map(F.lit("topic"), F.lit("alerts"), F.lit("urgent"), F.lit("true")), value > 150),
    ]


def _rule_config(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('t0','too-large',true,99), ('t1','odd-source',false,NULL), ('t2','band',true,1),"
        " ('t1','to-alerts',true,90) AS c(model_id, rule_id, enabled, priority_override)"
    )


@query(
    "rule_activation",
    """WITH r(rule_id, chain, p) AS (VALUES ('too-large','VALIDATE',10), ('odd-source','VALIDATE',20), ('cap','RECONCILE',5),
  ('steady','RECONCILE',9), ('band','ENRICH',50), ('default-k','ENRICH',10), ('default-band','ENRICH',10), ('to-topic','ROUTE',10), ('to-alerts','ROUTE',5)),
  t AS (SELECT DISTINCT concat('t', user_id % 3) AS model_id FROM events),
  c(model_id, rule_id, enabled, o) AS (VALUES ('t0','too-large',true,99), ('t1','odd-source',false,NULL), ('t2','band',true,1), ('t1','to-alerts',true,90))
SELECT t.model_id, r.rule_id, r.chain, coalesce(c.o, r.p) AS priority FROM t CROSS JOIN r
  LEFT JOIN c ON c.model_id = t.model_id AND c.rule_id = r.rule_id WHERE coalesce(c.enabled, true)""",
)
def rule_activation(spark, folder):
    tenants = mutations(spark, folder).select("model_id").distinct()
    config = tenants.join(_rule_config(spark), "model_id", "left")
    return rules.active_rules(_rules(), config).drop("position")


SQL_RULED = """, src AS (SELECT *, CAST(sent AS DOUBLE) AS v FROM mut),
verdict AS (SELECT *, coalesce(v > 250, false) AS large, source_system = 'error' AND model_id <> 't1' AS odd FROM src),
ruled AS (SELECT *, CASE WHEN model_id = 't0' AND large THEN 'too-large' WHEN odd THEN 'odd-source' WHEN large THEN 'too-large' END AS rejected_by FROM verdict)
"""


@query(
    "rule_reject",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RULED
    + """SELECT model_id, seq, rejected_by, CASE rejected_by WHEN 'too-large' THEN 'value above 250'
       WHEN 'odd-source' THEN 'errors may not write' END AS reject_reason FROM ruled""",
)
def rule_reject(spark, folder):
    found = rules.evaluate(mutations(spark, folder), _rules(), _rule_config(spark))
    return found.select("model_id", "seq", "rejected_by", "reject_reason")


@query(
    "rule_properties",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RULED
    + """SELECT model_id, seq,
       CASE WHEN v > 200 THEN '200' ELSE sent END AS value,
       CASE WHEN k = '7' THEN '1' ELSE coalesce(k, '0') END AS k,
       CASE WHEN model_id = 't2' THEN '"none"' WHEN v > 100 THEN '"high"' WHEN v IS NOT NULL THEN '"low"' ELSE '"none"' END AS band
     FROM ruled WHERE rejected_by IS NULL""",
)
def rule_properties(spark, folder):
    found = rules.evaluate(mutations(spark, folder), _rules(), _rule_config(spark)).filter(F.col("rejected_by").isNull())
    return found.select("model_id", "seq", *state_columns(found), F.col("payload")["band"].alias("band"))


@query(
    "rule_routes",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RULED
    + """SELECT model_id, seq, CASE WHEN v > 150 AND model_id <> 't1' THEN 'alerts' ELSE source_system END AS topic,
       CASE WHEN v > 150 THEN 'true' END AS urgent FROM ruled WHERE rejected_by IS NULL""",
)
def rule_routes(spark, folder):
    found = rules.evaluate(mutations(spark, folder), _rules(), _rule_config(spark)).filter(F.col("rejected_by").isNull())
    hint = F.col("routing_hints")
    return found.select("model_id", "seq", hint["topic"].alias("topic"), hint["urgent"].alias("urgent"))


@query(
    "rule_overrides",
    "WITH"
    + SQL_MUTATIONS
    + SQL_RULED
    + """SELECT model_id, seq, 'k' AS property, k AS losing_value, source_system AS losing_source, '' AS winning_source_id, '1' AS winning_value
     FROM ruled WHERE rejected_by IS NULL AND k = '7'""",
)
def rule_overrides(spark, folder):
    found = rules.evaluate(mutations(spark, folder), _rules(), _rule_config(spark))
    rows = found.select("model_id", "seq", F.explode("rule_conflicts").alias("c"))
    return rows.select("model_id", "seq", "c.property", "c.losing_value", "c.losing_source", "c.winning_source_id", "c.winning_value")


def _registry(spark):
    return spark.sql(
        "SELECT m AS model_id, 'user' AS type, p AS property, d AS data_type, r AS required FROM VALUES"
        " ('t0','value','double',true), ('t0','k','integer',true), ('t0','email','string',false),"
        " ('t1','value','integer',true), ('t1','k','string',false), ('t1','ref','uuid',true) AS x(m, p, d, r)"
    )


SQL_SHAPES = """, faults AS (
  SELECT model_id, node, seq, 'value' AS path, 'MinCountConstraintComponent' AS c FROM mut WHERE model_id IN ('t0', 't1') AND sent IS NULL
  UNION ALL SELECT model_id, node, seq, 'k', 'MinCountConstraintComponent' FROM mut WHERE model_id = 't0' AND k IS NULL
  UNION ALL SELECT model_id, node, seq, 'value', 'DatatypeConstraintComponent' FROM mut WHERE model_id = 't1' AND NOT regexp_full_match(sent, '-?[0-9]+')
  UNION ALL SELECT model_id, node, seq, 'k', 'DatatypeConstraintComponent' FROM mut WHERE model_id = 't1' AND regexp_full_match(k, '-?[0-9]+')
  UNION ALL SELECT model_id, node, seq, 'ref', 'MinCountConstraintComponent' FROM mut WHERE model_id = 't1')
"""


@query(
    "shape_violations",
    "WITH" + SQL_MUTATIONS + SQL_SHAPES + """SELECT model_id, node AS focus, seq, path, c AS "constraint", 'Violation' AS severity FROM faults""",
)
def shape_violations(spark, folder):
    return shapes.report(shapes.check_shapes(mutations(spark, folder), _registry(spark)))


@query(
    "shape_dead_letters",
    "WITH"
    + SQL_MUTATIONS
    + SQL_SHAPES
    + """SELECT model_id, seq, any_value(m.conn) AS connector_id, 'SHACL_VIOLATION' AS reason, concat(count(*), ' violations') AS detail
     FROM faults JOIN mut m USING (model_id, seq) GROUP BY model_id, seq""",
)
def shape_dead_letters(spark, folder):
    checked = shapes.check_shapes(mutations(spark, folder), _registry(spark))
    bad = F.size("violations") > 0
    letters = shapes.rejected(
        checked, F.when(bad, F.lit("SHACL_VIOLATION")), F.concat(F.size("violations").cast("string"), F.lit(" violations")), F.lit(None).cast("string")
    )
    return letters.select("model_id", "seq", "connector_id", "reason", "detail")


def _funnel(spark, folder):
    registry = spark.sql("SELECT m AS model_id, 'user' AS type, 'email' AS property, 'string' AS data_type, false AS required"
                         " FROM VALUES ('t0'), ('t1'), ('t2') AS x(m)")
    guard = [rules.Rule("too-large", "VALIDATE", 10, "reject", F.lit("value above 250"), F.col("payload")["value"].cast("double") > 250)]
    return run_funnel(mutations(spark, folder), registry, _authority(spark), guard, keys=STATE_KEYS)


SQL_FUNNEL = """, tried AS (SELECT *, coalesce(CAST(value AS DOUBLE) > 250, false) AS large FROM mut),
 echoed AS (SELECT *, coalesce(seq > min(CASE WHEN NOT large THEN seq END) OVER (PARTITION BY model_id, conn, change), false) AS echo FROM tried),
 clean AS (SELECT *, NOT large AND NOT echo AS ok FROM echoed),
 found AS (SELECT *, min(CASE WHEN ok AND op = 'CREATE' THEN seq END) OVER (PARTITION BY model_id, node) AS born FROM clean),
 verdict AS (SELECT *, CASE WHEN echo OR large THEN 'RULE_REJECT' WHEN op = 'CREATE' AND seq <> born THEN 'DUPLICATE_CREATE'
     WHEN op <> 'CREATE' AND (born IS NULL OR seq < born) THEN 'NODE_NOT_FOUND' END AS reason FROM found)
"""
SQL_FUNNEL_FOLD = (
    SQL_FUNNEL
    + SQL_AUTHORITY.replace("FROM mut)", "FROM verdict WHERE reason IS NULL)")
    + """, values_kept AS (SELECT v.model_id, v.node, v.seq, v.op, v.event_time, v.k, v.source_system, v.source_id,
    CASE WHEN s.seq IS NULL OR s.accepted THEN v.value ELSE s.current END AS value
    FROM verdict v LEFT JOIN settled s USING (model_id, node, seq) WHERE v.reason IS NULL)
"""
)


@query(
    "funnel_nodes",
    "WITH"
    + SQL_MUTATIONS
    + SQL_FUNNEL_FOLD
    + """SELECT model_id, node, max(seq) AS seq, max_by(value, seq) FILTER (WHERE value IS NOT NULL) AS value,
     max_by(k, seq) FILTER (WHERE k IS NOT NULL) AS k, bool_or(op = 'TOMBSTONE') AS tombstoned FROM values_kept GROUP BY model_id, node""",
)
def funnel_nodes(spark, folder):
    found = _funnel(spark, folder).nodes
    return found.select("model_id", "node", "seq", *state_columns(found, "props"), "tombstoned")


@query(
    "funnel_events",
    "WITH"
    + SQL_MUTATIONS
    + SQL_FUNNEL_FOLD
    + """SELECT model_id, node, seq, concat(op, '_NODE') AS event_type, last_value(value IGNORE NULLS) OVER w AS value,
     last_value(k IGNORE NULLS) OVER w AS k FROM values_kept WINDOW w AS (PARTITION BY model_id, node ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def funnel_events(spark, folder):
    found = _funnel(spark, folder).events
    return found.select("model_id", "node", "seq", "event_type", *state_columns(found))


@query("funnel_conflicts", "WITH" + SQL_MUTATIONS + SQL_FUNNEL_FOLD + SQL_CONFLICT.format(owner="creator"))
def funnel_conflicts(spark, folder):
    return _funnel(spark, folder).conflicts.drop("type", "rule_id")


@query(
    "funnel_dead_letters",
    "WITH"
    + SQL_MUTATIONS
    + SQL_FUNNEL
    + """SELECT model_id, seq, conn AS connector_id, reason, CASE WHEN echo THEN 'echo-loop-suppression' WHEN large THEN 'too-large' END AS rule_id
     FROM verdict WHERE reason IS NOT NULL""",
)
def funnel_dead_letters(spark, folder):
    return _funnel(spark, folder).dlq.select("model_id", "seq", "connector_id", "reason", "rule_id")


@query(
    "funnel_outbox",
    "WITH" + SQL_MUTATIONS + SQL_FUNNEL + "SELECT concat(model_id, '.user') AS aggregatetype, count(*) AS n FROM verdict WHERE reason IS NULL GROUP BY model_id",
)
def funnel_outbox(spark, folder):
    return _funnel(spark, folder).outbox.groupBy("aggregatetype").agg(F.count(F.lit(1)).alias("n"))
