"""Landed JSON, text documents, model responses, and the log's sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.functions.literals import quote
from graphlog.functions.text import content_hash, transform
from graphlog.operators import report
from graphlog.plans.ingest import Mapping, ingest_extractions, ingest_rows
from graphlog.sources import documents, rows, sinks
from graphlog.sources.rows import Field
from graphlog.storage import scratch_path
from workload.fixtures import SQL_HISTORY, at, events, nodes, table
from workload.registry import query

FIELDS = [
    Field("line", "$.line", "parse-int", required=True),
    Field("part", "$.part", "lowercase", required=True),
    Field("flag", "$.detail.flag", "trim"),
    Field("ship", "$.ship", "iso8601-date"),
    Field("price", "$.price", "parse-decimal"),
    Field("tax", "$.tax", "sha256"),
    Field("note", "$.note"),
]


def _raw(spark, folder):
    """One JSON document per order, with its lines under ``data``."""
    ship = F.when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "N"), "soon").otherwise(
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00+01:00"))
    )
    line = F.struct(
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("PART-"), F.col("l_partkey").cast("string"))).alias("part"),
        F.struct(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("flag")).alias("detail"),
        ship.alias("ship"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("l_tax").cast("decimal(4,2)").cast("string").alias("tax"),
    )
    # written a line at a time: text is sorted and gathered faster than nested rows
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.to_json(line).alias("text")).alias("line"))
    listed = F.sort_array(F.collect_list("line"))["text"]
    return lines.groupBy("l_orderkey").agg(F.concat(F.lit('{"data":['), F.array_join(listed, ","), F.lit("]}")).alias("value"))


def _mapped(spark, folder):
    return rows.map_rows(rows.explode_rows(_raw(spark, folder), "$.data[*]"), FIELDS)


SQL_LINES = """lines AS (SELECT l_orderkey, l_linenumber AS line, concat('part-', l_partkey) AS part, l_returnflag AS flag,
  concat(strftime(l_shipdate - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S'), 'Z') AS ship,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, sha256(CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR)) AS tax,
  CASE WHEN l_linenumber >= 7 THEN 'no value at $.part'
       WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN 'Cannot apply iso8601-date to $.ship: soon' END AS error FROM lineitem)
"""


@query(
    "map_rows",
    "WITH " + SQL_LINES + """SELECT l_orderkey, CAST(line AS VARCHAR) AS line, concat('"', part, '"') AS part, concat('"', flag, '"') AS flag,
     concat('"', ship, '"') AS ship, price, concat('"', tax, '"') AS tax, 6 AS size FROM lines WHERE error IS NULL""",
)
def map_rows(spark, folder):
    good, _ = rows.split_errors(_mapped(spark, folder))
    p = F.col("properties")
    return good.select("l_orderkey", *[p[f.target].alias(f.target) for f in FIELDS[:-1]], F.size(p).alias("size"))


@query("mapping_dead_letters", "WITH " + SQL_LINES + "SELECT l_orderkey, 'MAPPING_ERROR' AS reason, error AS detail FROM lines WHERE error IS NOT NULL")
def mapping_dead_letters(spark, folder):
    _, bad = rows.split_errors(_mapped(spark, folder))
    return bad.select("l_orderkey", "reason", "detail")


@query(
    "row_hash",
    "WITH " + SQL_LINES + """SELECT l_orderkey, sha256(concat_ws(chr(10), 'flag=' || flag, 'line=' || line, 'note=', 'part=' || part,
     'price=' || price, 'ship=' || ship, 'tax=' || tax)) AS source_hash FROM lines WHERE error IS NULL""",
)
def row_hash(spark, folder):
    return rows.split_errors(_mapped(spark, folder))[0].select("l_orderkey", "source_hash")


@query(
    "field_transforms",
    """SELECT event_id, lower(event_type) AS low, upper(event_type) AS up, trim(concat(' ', event_type, '  ')) AS cut, sha256(event_type) AS sha,
       CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS num,
       concat(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S'), 'Z') AS iso, CAST(value AS VARCHAR) AS dec FROM events""",
)
def field_transforms(spark, folder):
    kind = F.col("event_type")
    number = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" +"), F.col("event_id").cast("string"))).otherwise("n/a")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return table(spark, folder, "events").select(
        "event_id",
        transform("lowercase", F.upper(kind)).alias("low"),
        transform("UPPERCASE", kind).alias("up"),
        transform("trim", F.concat(F.lit(" "), kind, F.lit("  "))).alias("cut"),
        transform("sha256", kind).alias("sha"),
        transform("parse-int", number).cast("string").alias("num"),
        transform("iso8601-date", iso).alias("iso"),
        transform("parse-decimal", F.concat(F.lit("+"), F.col("value").cast("string"))).alias("dec"),
    )


def _existing(spark, folder):
    """Last run's customers: some changed since, some not there yet."""
    c = table(spark, folder, "customer").filter("c_nationkey <> 3")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "OLD").otherwise(F.col("c_mktsegment"))
    old = content_hash({"name": F.col("c_name"), "segment": segment})
    return c.select(
        F.concat(F.lit("t"), (F.col("c_custkey") % 2).cast("string")).alias("model_id"), F.lit("customer").alias("type"),
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_custkey").alias("seq"),
        F.create_map(F.lit("name"), quote(F.col("c_name")), F.lit("_source_hash"), quote(old)).alias("props"),
    )


def _landed(spark, folder):
    """Customers as one JSON document each."""
    value = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("rows")))
    return table(spark, folder, "customer").select(
        F.concat(F.lit("t"), (F.col("c_custkey") % 2).cast("string")).alias("model_id"), F.lit("crm").alias("connector_id"),
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("change_id"), value.alias("value"),
    )


CUSTOMERS = Mapping("$.rows[*]", "customer", "crm", ["name"], [Field("name", "$.name", required=True), Field("segment", "$.segment")])

SQL_UPSERT = """SELECT concat('t', c_custkey % 2) AS model_id, CASE WHEN c_nationkey = 3 THEN 'CREATE' ELSE 'UPDATE' END AS operation,
  CASE WHEN c_nationkey <> 3 THEN concat('customer:', c_custkey) END AS node, c_name AS name, {more} FROM customer
  WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'"""


@query("upsert_classify", SQL_UPSERT.format(more="sha256(concat('name=', c_name, chr(10), 'segment=', c_mktsegment)) AS source_hash"))
def upsert_classify(spark, folder):
    mapped = rows.map_rows(rows.explode_rows(_landed(spark, folder), CUSTOMERS.root), CUSTOMERS.fields)
    typed = mapped.withColumn("type", F.lit("customer"))
    found = rows.classify(typed, _existing(spark, folder), ["name"])
    return found.select("model_id", "operation", "node", F.regexp_replace(F.col("properties")["name"], '"', "").alias("name"), "source_hash")


@query(
    "candidate_mutations",
    SQL_UPSERT.format(more="'STRUCTURED' AS source_type, CAST(1 AS DOUBLE) AS confidence, 'crm' AS origin_connector_id, concat('d', c_custkey, ':0') AS origin_change_id"),
)
def candidate_mutations(spark, folder):
    made, _ = ingest_rows(_landed(spark, folder), CUSTOMERS, _existing(spark, folder))
    return made.select(
        "model_id", "operation", "node", F.regexp_replace(F.col("payload")["name"], '"', "").alias("name"), "source_type",
        F.col("confidence").cast("double").alias("confidence"), "origin_connector_id", "origin_change_id",
    )


def _runs(spark, folder):
    """A run per connector and day of events; errors are rows that failed."""
    ev = table(spark, folder, "events").select(
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("connector_id"), F.date_trunc("hour", "ts").alias("poll_at"),
        "event_type", "value",
    ).withColumn("run_id", F.concat_ws("@", "connector_id", F.date_format("poll_at", "yyyyMMddHH")))
    status = F.when(F.col("event_type") == "error", "mapped_error").when(F.col("value") > 150, "rejected").otherwise("committed")
    runs = ev.groupBy("run_id", "connector_id", "poll_at").agg(F.min("event_type").alias("low")).withColumn("unchanged", F.col("low") == "view")
    return runs.drop("low"), ev.select("run_id", status.alias("status"))


SQL_RUNS = """ev AS (SELECT concat('c', event_id % 4) AS connector_id, date_trunc('hour', ts) AS poll_at, event_type, value FROM events),
runs AS (SELECT connector_id, poll_at, min(event_type) = 'view' AS unchanged,
  count(*) FILTER (WHERE event_type = 'error') AS m, count(*) FILTER (WHERE event_type <> 'error' AND value > 150) AS r,
  count(*) FILTER (WHERE event_type <> 'error' AND value <= 150) AS d FROM ev GROUP BY connector_id, poll_at),
outcomes AS (SELECT concat(connector_id, '@', strftime(poll_at, '%Y%m%d%H')) AS run_id, connector_id, poll_at, d AS processed, m + r AS dlq,
  CASE WHEN unchanged THEN 'NO_CHANGE' WHEN m > 0 AND r + d = 0 THEN 'FAILED' WHEN m > 0 THEN 'PARTIAL' WHEN r > 0 AND d > 0 THEN 'PARTIAL'
       WHEN r > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome FROM runs),
status AS (SELECT connector_id, epoch_us(max(poll_at)) AS last_poll_at, epoch_us(max(CASE WHEN outcome IN ('SUCCESS', 'NO_CHANGE') THEN poll_at END)) AS last_success_at,
  max_by(outcome, poll_at) AS last_outcome, CAST(sum(processed) AS BIGINT) AS events_processed, CAST(sum(dlq) AS BIGINT) AS dlq_count FROM outcomes GROUP BY connector_id)
"""


@query("run_outcomes", "WITH " + SQL_RUNS + "SELECT run_id, outcome, processed, dlq FROM outcomes")
def run_outcomes(spark, folder):
    return rows.run_outcomes(*_runs(spark, folder)).select("run_id", "outcome", "processed", "dlq")


def _status(spark, folder):
    return rows.sync_status(rows.run_outcomes(*_runs(spark, folder)))


@query("sync_rollup", "WITH " + SQL_RUNS + "SELECT * FROM status")
def sync_rollup(spark, folder):
    found = _status(spark, folder)
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("last_poll_at", "last_success_at")]
    return found.select("connector_id", *micros, "last_outcome", "events_processed", "dlq_count")


def _connectors(spark):
    return spark.sql("SELECT * FROM VALUES ('c0', true), ('c1', true), ('c2', false), ('c9', true) AS c(connector_id, enabled)")


@query(
    "connector_health",
    "WITH " + SQL_RUNS + "SELECT c.connector_id, s.last_outcome FROM (VALUES ('c0'), ('c1'), ('c9')) AS c(connector_id) LEFT JOIN status s USING (connector_id)",
)
def connector_health(spark, folder):
    return report.connector_health(_connectors(spark), _status(spark, folder)).select("connector_id", "last_outcome")


@query(
    "overall_health",
    "WITH " + SQL_RUNS + "SELECT CASE WHEN bool_or(last_outcome = 'FAILED' AND connector_id IN ('c0', 'c1')) THEN 'DOWN' ELSE 'UP' END AS status FROM status",
)
def overall_health(spark, folder):
    return report.overall_health(report.connector_health(_connectors(spark), _status(spark, folder)))


@query(
    "text_folder_scan",
    """SELECT concat('doc_id=', doc_id) AS folder, octet_length(encode(text)) + 1 AS size, sha256(concat(text, chr(10))) AS hash FROM documents
       WHERE octet_length(encode(text)) + 1 <= 20000""",
)
def text_folder_scan(spark, folder):
    found, _ = documents.scan_folder(spark, _text_folder(spark, folder), "**/*.txt", 20000)
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "size", F.sha2("text", 256).alias("hash"))


def _text_folder(spark, folder):
    path = scratch_path(spark)
    documents.write_folder(table(spark, folder, "documents"), path, "doc_id")
    return path


@query(
    "text_folder_oversize",
    """SELECT 'FILE_TOO_LARGE' AS reason, concat('doc_id=', doc_id) AS folder FROM documents WHERE octet_length(encode(text)) + 1 > 20000""",
)
def text_folder_oversize(spark, folder):
    _, large = documents.scan_folder(spark, _text_folder(spark, folder), "**/*.txt", 20000)
    where = F.get_json_object("raw_payload", "$.path")
    return large.select("reason", F.substring_index(where, "/", 1).alias("folder"))


def _docs(spark, folder):
    return table(spark, folder, "documents").select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "doc_id", "text"
    )


@query("changed_docs", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def changed_docs(spark, folder):
    docs = _docs(spark, folder)
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    previous = docs.filter("doc_id % 7 <> 0").select("path", F.sha2(old, 256).alias("content_hash"))
    return documents.changed_documents(docs, previous).select("doc_id", "content_hash")


SQL_CHUNKS = """cut AS (SELECT doc_id, {parts} AS parts, {gaps} AS gaps FROM ({source})),
 pieces AS (SELECT doc_id, i, parts[i] AS piece, length(parts[i]) AS len, coalesce(length(gaps[i]), 0) AS gap
   FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut)),
 placed AS (SELECT *, coalesce(sum(len + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset FROM pieces),
 kept AS (SELECT *, row_number() OVER w - 1 AS chunk_index, lag(piece) OVER w AS before FROM placed
   WHERE regexp_matches(piece, '\\S') WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_offset AS INTEGER) AS char_offset, CAST(len AS INTEGER) AS char_length,
  md5(concat(coalesce(right(before, {overlap}), ''), piece)) AS text FROM kept"""


def _digested(chunks):
    return chunks.select("doc_id", "chunk_index", "char_offset", "char_length", F.md5("text").alias("text"))


@query(
    "paragraph_chunks",
    "WITH " + SQL_CHUNKS.format(
        parts="regexp_split_to_array(t, '\\n{2,}')", gaps="regexp_extract_all(t, '\\n{2,}')",
        source="SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents", overlap=50),
)
def paragraph_chunks(spark, folder):
    doubled = _docs(spark, folder).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return _digested(documents.paragraph_chunks(doubled, 50))


@query(
    "sentence_chunks",
    "WITH " + SQL_CHUNKS.format(
        # no look-ahead here: a full stop that a lower-case letter follows is first cut off from its spaces by a mark
        parts="""list_transform(regexp_extract_all(regexp_replace(text, '([.]["'')\\]]*)([ \\t\\r\\n]+\\p{Ll})', '\\1' || chr(57344) || '\\2', 'g'),
            '(?s).*?(?:[.!?]["'')\\]]*[ \\t\\r\\n]+|\\z)'), lambda p: replace(p, chr(57344), ''))""", gaps="CAST([] AS VARCHAR[])",
        source="SELECT doc_id, text FROM documents", overlap=200),
)
def sentence_chunks(spark, folder):
    return _digested(documents.sentence_chunks(_docs(spark, folder).select("doc_id", "text")))


@query(
    "document_ids",
    """SELECT doc_id, sha256(concat('md:', source, '/', doc_id, '.md:', n_chars)) AS source_document_id,
       sha256(concat(sha256(concat('md:', source, '/', doc_id, '.md:', n_chars)), ':doc:', lang)) AS change_id,
       concat(doc_id, ':', n_chars) AS source_chunk_range FROM documents""",
)
def document_ids(spark, folder):
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    found = table(spark, folder, "documents").withColumn("source_document_id", documents.document_id(F.lit("md"), path, F.col("n_chars")))
    change = documents.change_id(F.col("source_document_id"), F.lit("doc"), F.col("lang"))
    return found.select("doc_id", "source_document_id", change.alias("change_id"), documents.chunk_range(F.col("doc_id"), F.col("n_chars")).alias("source_chunk_range"))


def _responses(spark, folder):
    """Conversation turns as model output: fenced, plain, or cut short."""
    entity = F.struct(
        F.col("role").alias("typeSlug"), F.concat_ws("/", F.col("conv_id"), F.col("turn")).alias("name"),
        F.struct(F.col("text").alias("body"), F.col("turn").alias("turn")).alias("properties"),
        F.struct(F.col("turn").alias("offset"), F.length("text").alias("length")).alias("sourceSpan"), F.lit(0.75).alias("confidence"),
    )
    body = F.to_json(F.array(entity))
    text = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("\n "), body))
        .otherwise(F.substring(body, 1, 40))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", text.alias("response"))


@query(
    "parse_candidates",
    """SELECT conv_id, role AS type, concat(conv_id, '/', turn) AS name, md5(text) AS body, CAST(turn AS VARCHAR) AS turn_text, 0.75 AS confidence,
       length(text) AS span FROM conversations WHERE turn % 3 <> 2""",
)
def parse_candidates(spark, folder):
    found, _ = documents.parse_responses(_responses(spark, folder))
    p = F.col("properties")
    return documents.extracted_properties(found).select(
        "conv_id", "type", "name", F.md5(F.get_json_object(F.concat(F.lit('{"b":'), p["body"], F.lit("}")), "$.b")).alias("body"),
        p["turn"].alias("turn_text"), F.col("confidence").cast("double").alias("confidence"), F.col("source_span.length").alias("span"),
    )


@query("extraction_dead_letters", "SELECT conv_id, turn, 'EXTRACTION_ERROR' AS reason FROM conversations WHERE turn % 3 = 2")
def extraction_dead_letters(spark, folder):
    return documents.parse_responses(_responses(spark, folder))[1].select("conv_id", "turn", "reason")


@query(
    "extraction_ingest",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'MUTATION' ELSE 'REVIEW' END AS went, count(*) AS n FROM part GROUP BY 1""",
)
def extraction_ingest(spark, folder):
    known = nodes(spark, folder, tenants=1, only=["part"]).select(
        "model_id", "node", "type", F.get_json_object(F.concat(F.lit('{"b":'), F.col("props")["name"], F.lit("}")), "$.b").alias("name")
    )
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(
        F.concat(F.lit("0123456789 stranger "), F.col("p_partkey").cast("string"))
    )
    entity = F.struct(F.lit("part").alias("typeSlug"), name.alias("name"), F.lit(0.9).alias("confidence"))
    responses = table(spark, folder, "part").select(
        F.lit("t0").alias("model_id"), F.lit("md").alias("connector_id"), F.concat(F.lit("doc"), F.col("p_partkey").cast("string")).alias("source_document_id"),
        F.lit("0:10").alias("source_chunk_range"), F.to_json(F.array(entity)).alias("response"),
    )
    made, queued, _ = ingest_extractions(responses, known, 0.9, at("2024-01-01 00:00:00"))
    parts = made.select(F.lit("MUTATION").alias("went")).unionByName(queued.select(F.lit("REVIEW").alias("went")))
    return parts.groupBy("went").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_log_sink",
    "WITH" + SQL_HISTORY + "SELECT strftime(event_time, '%Y-%m') AS event_month, event_type, count(*) AS n FROM evt GROUP BY ALL",
)
def event_log_sink(spark, folder):
    path = scratch_path(spark)
    sinks.write_events(events(spark, folder), path)
    stored = sinks.read_events(spark, path)
    return stored.groupBy(F.col("event_month").cast("string").alias("event_month"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "topic_sink",
    "WITH" + SQL_HISTORY + "SELECT concat('graph.', model_id, '.user') AS topic, node AS key, md5(json) AS value, event_type AS header FROM evt",
)
def topic_sink(spark, folder):
    path = scratch_path(spark)
    sinks.write_topics(sinks.topic_rows(events(spark, folder)), path)
    stored = spark.read.parquet(path)
    header = F.decode(F.col("headers")[0]["value"], "UTF-8")
    return stored.select("topic", "key", F.md5("value").alias("value"), header.alias("header"))
