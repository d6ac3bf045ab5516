"""Landed JSON into candidate rows: mapping, hashing, upsert classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.functions.literals import quote, unquote
from graphlog.functions.text import TRANSFORMS, content_hash, transform
from graphlog.model import CREATE, UPDATE

MAPPING_ERROR = "MAPPING_ERROR"


@dataclass(frozen=True)
class Field:
    target: str
    path: str
    transform: str | None = None
    required: bool = False


def read_json(spark, path: str) -> DataFrame:
    """Whole JSON documents, one per file: columns ``value`` and ``document``."""
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("document"))


def explode_rows(raw: DataFrame, root: str = "$") -> DataFrame:
    """One row per element of the array at ``root``; ``row`` is a variant.

    A document that is no JSON, or has nothing at the root, yields no rows.
    """
    path = root.removesuffix("[*]").rstrip(".") or "$"
    rest = [c for c in raw.columns if c != "value"]
    listed = raw.select(*rest, F.try_variant_get(F.try_parse_json("value"), path, "variant").alias("_list"))
    elements = listed.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return elements.select(*rest, F.col("pos").alias("position"), F.col("value").alias("row"))


def failed_documents(raw: DataFrame, root: str = "$") -> DataFrame:
    """Documents whose root path is missing: their run fails as a whole."""
    path = root.removesuffix("[*]").rstrip(".") or "$"
    return raw.filter(F.try_variant_get(F.try_parse_json("value"), path, "variant").isNull())


def _value(kind: str, raw: Column | None, text: Column) -> Column:
    """Plain text of a mapped value; null for null input or a failure."""
    if kind == "none":
        return text
    if kind == "parse-int":
        number = F.when(~raw.startswith('"'), text.try_cast("double").cast("bigint")).otherwise(transform(kind, text))
        return number.cast("string")
    return transform(kind, text)


def _literal(kind: str, raw: Column | None, value: Column) -> Column:
    if kind == "none":
        return F.when(value.isNotNull(), raw)
    if kind in ("parse-int", "parse-decimal"):
        return value
    plain = F.concat(F.lit('"'), value, F.lit('"'))
    if kind in ("sha256", "iso8601-date"):
        return plain
    return F.when(value.rlike(r'["\\\x00-\x1f]'), quote(value)).otherwise(plain)


def map_rows(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Add ``properties``, ``source_hash`` and ``error`` to exploded rows.

    The first failing field, in mapping order, names the error. A JSON null
    is present but gives no property; a missing optional field likewise. Each
    step is its own projection, so no path is read twice. No step uses a
    lambda: Spark would interpret all expressions around it row by row.
    """
    kinds = [(f.transform or "none").lower() for f in fields]
    for kind in kinds:
        if kind not in TRANSFORMS:
            raise ValueError(f"unknown transform: {kind}")
    n = range(len(fields))
    # only these tell a text from a number; JSON text costs more than the plain one
    spelt = [i for i in n if kinds[i] in ("none", "parse-int")]
    raw = {i: F.col(f"_raw{i}") if i in spelt else None for i in n}

    def read(i: int, kind: str) -> Column:
        return F.try_variant_get("row", fields[i].path, kind)

    def text(i: int) -> Column:
        if i not in spelt:
            return read(i, "string")
        return F.when(~raw[i].startswith('"') & (raw[i] != "null"), raw[i]).otherwise(read(i, "string"))

    found = rows.select("*", *[F.to_json(read(i, "variant")).alias(f"_raw{i}") for i in spelt])
    texts = found.select("*", *[text(i).alias(f"_text{i}") for i in n])
    values = texts.select(
        "*",
        *[_value(kinds[i], raw[i], F.col(f"_text{i}")).alias(f"_value{i}") for i in n],
        *[(F.col(f"_text{i}").isNull() & read(i, "variant").isNull()).alias(f"_missing{i}") for i in n if fields[i].required],
    )

    def error(i: int) -> Column:
        failed = F.col(f"_text{i}").isNotNull() & F.col(f"_value{i}").isNull()
        told = F.when(failed, F.concat(F.lit(f"Cannot apply {kinds[i]} to {fields[i].path}: "), F.col(f"_text{i}")))
        if fields[i].required:
            missing = F.when(F.col(f"_missing{i}"), F.lit(f"no value at {fields[i].path}"))
            told = F.coalesce(missing, told)
        return told

    none = F.array().cast("array<struct<k:string,v:string>>")

    def entry(i: int) -> Column:
        literal = _literal(kinds[i], raw[i], F.col(f"_value{i}"))
        pair = F.struct(F.lit(fields[i].target).alias("k"), literal.alias("v"))
        return F.when(F.col(f"_value{i}").isNotNull(), F.array(pair)).otherwise(none)

    # a filter on ``error`` stays above this row generator; pushed below, it
    # would evaluate every path and transform a second time
    told = values.select("*", F.inline(F.array(F.struct(F.coalesce(*[error(i) for i in n]).alias("error")))))
    return told.select(
        *rows.columns,
        "error",
        F.map_from_entries(F.concat(*[entry(i) for i in n])).alias("properties"),
        content_hash({fields[i].target: F.col(f"_value{i}") for i in n}).alias("source_hash"),
    )


def split_errors(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with reason, detail and the raw row)."""
    good = mapped.filter(F.col("error").isNull()).drop("error")
    rest = [c for c in mapped.columns if c not in ("row", "properties", "source_hash", "error")]
    bad = mapped.filter(F.col("error").isNotNull()).select(
        *rest, F.lit(MAPPING_ERROR).alias("reason"), F.col("error").alias("detail"), F.to_json("row").alias("raw_payload")
    )
    return good, bad


def classify(rows: DataFrame, existing: DataFrame, identity: list[str]) -> DataFrame:
    """UPDATE with the known node, or CREATE; rows with an equal hash drop out.

    ``rows`` has (model_id, type, properties, source_hash); ``existing`` has
    (model_id, type, node, seq, props). Identity values compare as text and
    null never matches; the oldest of several matches is taken.
    """
    ids = [f"_id{i}" for i in range(len(identity))]
    key = ["model_id", "type", *ids]

    def keyed(df: DataFrame, props: str) -> DataFrame:
        return df.select("*", *[unquote(F.col(props)[name]).alias(i) for name, i in zip(identity, ids)])

    known = keyed(existing, "props").groupBy(*key).agg(
        F.min_by(F.struct("node", unquote(F.col("props")["_source_hash"]).alias("hash")), "seq").alias("_known")
    )
    joined = keyed(rows, "properties").join(known, key, "left")
    changed = joined.filter(~F.col("source_hash").eqNullSafe(F.col("_known.hash")))
    hashed = F.map_concat("properties", F.create_map(F.lit("_source_hash"), quote(F.col("source_hash"))))
    return changed.select(
        *[c for c in rows.columns if c != "properties"],
        hashed.alias("properties"),
        F.col("_known.node").alias("node"),
        F.when(F.col("_known.node").isNotNull(), F.lit(UPDATE)).otherwise(F.lit(CREATE)).alias("operation"),
    )


def to_mutations(candidates: DataFrame) -> DataFrame:
    """Candidates as mutations; absent optional columns count as null."""
    none = F.lit(None).cast("string")

    def has(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in candidates.columns else none.cast(kind)

    return candidates.select(
        "model_id",
        F.when(has("node").isNotNull(), F.lit(UPDATE)).otherwise(F.lit(CREATE)).alias("operation"),
        "type",
        has("node").alias("node"),
        F.col("properties").alias("payload"),
        F.when(has("source_document_id").isNotNull(), F.lit("UNSTRUCTURED")).otherwise(F.lit("STRUCTURED")).alias("source_type"),
        has("connector_id").alias("source_id"),
        has("source_system").alias("source_system"),
        F.coalesce(has("confidence", "decimal(4,3)"), F.lit(1)).cast("decimal(4,3)").alias("confidence"),
        has("extractor_version").alias("extractor_version"),
        has("extractor_model").alias("extractor_model"),
        has("source_document_id").alias("source_document_id"),
        has("source_chunk_range").alias("source_chunk_range"),
        has("connector_id").alias("origin_connector_id"),
        has("change_id").alias("origin_change_id"),
    )


def run_outcomes(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of each run from its rows.

    ``runs`` has (run_id, connector_id, poll_at, unchanged); ``results`` has
    (run_id, status) with status mapped_error, rejected or committed.
    """
    counted = results.groupBy("run_id").agg(
        F.count_if(F.col("status") == "mapped_error").alias("_mapping"),
        F.count_if(F.col("status") == "rejected").alias("_refused"),
        F.count_if(F.col("status") == "committed").alias("_done"),
    )
    zero = F.lit(0).cast("long")
    mapping, refused, done = (F.coalesce(F.col(c), zero) for c in ("_mapping", "_refused", "_done"))
    outcome = (
        F.when(F.col("unchanged"), F.lit("NO_CHANGE"))
        .when((mapping > 0) & (refused + done == 0), F.lit("FAILED"))
        .when(mapping > 0, F.lit("PARTIAL"))
        .when((refused > 0) & (done > 0), F.lit("PARTIAL"))
        .when(refused > 0, F.lit("FAILED"))
        .otherwise(F.lit("SUCCESS"))
    )
    return runs.join(counted, "run_id", "left").select(
        "run_id", "connector_id", "poll_at", outcome.alias("outcome"), done.alias("processed"), (mapping + refused).alias("dlq")
    )


def sync_status(outcomes: DataFrame) -> DataFrame:
    """Per connector: the last run, the last good one, and running totals."""
    good = F.col("outcome").isin("SUCCESS", "NO_CHANGE")
    return outcomes.groupBy("connector_id").agg(
        F.max("poll_at").alias("last_poll_at"),
        F.max(F.when(good, F.col("poll_at"))).alias("last_success_at"),
        F.max_by("outcome", "poll_at").alias("last_outcome"),
        F.sum("processed").alias("events_processed"),
        F.sum("dlq").alias("dlq_count"),
    )
