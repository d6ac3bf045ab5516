"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 500_000


def session(app: str, cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the one ``spark.checkpoint.dir`` names.

    It is removed when the driver ends, as nothing written there is a result.
    A temporary folder is used only by a local master that names none: on a
    cluster the executors would not see it.
    """
    context = spark.sparkContext
    own = _OWN.get(context.applicationId)
    if own is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="graphlog-")
        own = _OWN[context.applicationId] = f"{shared.rstrip('/')}/graphlog-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, own)
    return own


_OWN: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        files, where = file_system(spark, path)
        files.delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone, and the folder with it
        pass


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, is columnar, and later readers
    prune its columns; the plan above it starts from files instead of from the
    whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema])


def distinct_rows(df: DataFrame, count: int | None = None, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df.distinct()``, by tasks of about ``rows`` rows at any size.

    A plain ``distinct`` first holds what a whole split or join task brings,
    repeated or not. Here rows are counted, from what is written of them
    unless the caller knows their ``count``, dealt by all columns, and only
    then made distinct.
    """
    if count is None:
        df = materialise(df)
        count = df.count()
    few = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // 50_000))
    return df.repartition(max(1, few, -(-count // rows)), *df.columns).distinct()
