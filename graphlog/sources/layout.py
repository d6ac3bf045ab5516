"""Stored layouts of nodes and edges, so that small reads stay small.

Nodes are written twice. By key: one file per bucket of (tenant, node), so that
a lookup opens one file, whose name follows from the key. By number: files are
ranges of (tenant, type, seq), with a table of each file's bounds per tenant,
so that a page opens the files that hold it and no other. Edges are written as
steps, bucketed and sorted by (tenant, node): a hop joins them where they lie.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphlog.operators.read import bounded, cut, matching
from graphlog.storage import file_system, materialise, scratch_path

ROWS_PER_FILE = 1_000_000
ROWS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 100_000  # what Spark allows a bucketed table


class NodeStore:
    """Nodes as ``write`` laid them out below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema("buckets int, schema string").json(f"{self.path}/about").first()
        self.buckets, self.schema = about.buckets, StructType.fromJson(json.loads(about.schema))

    @staticmethod
    def write(nodes: DataFrame, path: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> NodeStore:
        """Lay out ``nodes`` (model_id, node, type, seq, ...); without a path, in the application's scratch folder.

        A tenant or type of any size is spread over as many files as its rows
        need; several small ones share a file.
        """
        spark = nodes.sparkSession
        path = (path or scratch_path(spark)).rstrip("/")
        parts = max(1, -(-nodes.count() // rows_per_file))
        by_key = nodes.withColumn("_bucket", _bucket(parts)).repartitionById(parts, F.col("_bucket"))
        by_key.sortWithinPartitions("model_id", "node").write.partitionBy("_bucket").parquet(f"{path}/by_key")
        order = ["model_id", "type", "seq"]
        nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/by_seq")
        held = spark.read.schema(nodes.schema).parquet(f"{path}/by_seq").select(*order, F.col("_metadata.file_name").alias("file"))
        bounds = held.groupBy("model_id", "type", "file").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
        bounds.repartition("model_id").sortWithinPartitions("type", "first").write.partitionBy("model_id").parquet(f"{path}/bounds")
        about = spark.range(1).select(F.lit(parts).alias("buckets"), F.lit(nodes.schema.json()).alias("schema"))
        about.coalesce(1).write.json(f"{path}/about")  # last: a folder without it is not whole
        return NodeStore(spark, path)

    def _read(self, *paths: str) -> DataFrame:
        some = [p for p in paths if (lambda fs, where: fs.exists(where))(*file_system(self.spark, p))]
        return self.spark.read.schema(self.schema).parquet(*some) if some else self.spark.createDataFrame([], self.schema)

    def lookup(self, model_id: str, node: str) -> DataFrame:
        """The node, from the one file that may hold it."""
        key = self.spark.range(1).select(F.lit(model_id).alias("model_id"), F.lit(node).alias("node"))
        bucket = key.select(_bucket(self.buckets)).first()[0]
        return self._read(f"{self.path}/by_key/_bucket={bucket}").filter((F.col("model_id") == model_id) & (F.col("node") == node))

    def lookup_many(self, keys: DataFrame) -> DataFrame:
        """Nodes named by a table of (model_id, node); only buckets that have a key need reading."""
        wanted = keys.select("model_id", "node").distinct().withColumn("_bucket", _bucket(self.buckets))
        whole = self.spark.read.schema(StructType([*self.schema, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/by_key")
        return whole.join(wanted, ["_bucket", "model_id", "node"], "left_semi").select(*self.schema.names)

    def page(self, model_id: str, node_type: str, after: int = 0, limit: int | None = None, where: Column | None = None, most: int = 500) -> DataFrame:
        """As ``read.page``, from the files whose bounds lie at the page."""
        return self._page(model_id, node_type, after, bounded(limit, 50, most), where)

    def filtered_page(self, model_id: str, node_type: str, equal: dict[str, str], after: int = 0, limit: int | None = None, most: int = 100) -> DataFrame:
        """As ``read.filtered_page``; the rarer the match, the more files until the page is full."""
        return self._page(model_id, node_type, after, bounded(limit, 20, most), matching(equal))

    def _page(self, model_id: str, node_type: str, after: int, size: int, where: Column | None) -> DataFrame:
        own = self.spark.read.schema("type string, file string, first long, last long, n long, model_id string").parquet(f"{self.path}/bounds")
        own = own.filter((F.col("model_id") == model_id) & (F.col("type") == node_type))
        files: list[str] = []
        at, chunk = after, 2
        while True:
            ahead = own.filter(F.col("last") > at).orderBy("first", "last").limit(chunk).collect()
            files += [f"{self.path}/by_seq/{r.file}" for r in ahead]
            rows = self._read(*files).filter((F.col("model_id") == model_id) & (F.col("type") == node_type))
            if len(ahead) < chunk:
                break
            # all rows of the files but the first lie past ``after``
            if where is None and sum(r.n for r in ahead[1:]) > size:
                break
            found = rows.filter(F.col("seq") > after)
            if (found if where is None else found.filter(where)).limit(size + 1).count() > size:
                break
            at, chunk = ahead[-1].last, chunk * 2
        return cut(rows, after, size, where)


def _bucket(parts: int) -> Column:
    return F.pmod(F.xxhash64("model_id", "node"), F.lit(parts)).cast("int")


def stored_steps(step: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(model_id, a, b), written bucketed and sorted by (model_id, a), one file a bucket.

    Joined on these columns it needs no shuffle, at any size. The table
    lives in the session's catalog and the application's scratch folder.
    """
    spark = step.sparkSession
    step = materialise(step)  # counted and placed, but worked out once
    count = step.count()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 50_000))
    buckets = min(max(1, few, -(-count // rows_per_bucket)), MOST_BUCKETS)
    name = f"graphlog_steps_{uuid.uuid4().hex}"
    placed = step.repartition(buckets, "model_id", "a")
    placed.write.bucketBy(buckets, "model_id", "a").sortBy("model_id", "a").option("path", scratch_path(spark)).saveAsTable(name)
    return spark.table(name)
