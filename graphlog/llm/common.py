"""Helpers the text operators share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: what counts as a word in every contract of this package
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for a shuffle whose size was not measured: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(key: tuple, build: Callable):
    """What ``build`` makes, kept while this Python worker serves the same operator.

    Task code is shipped by value, so that a module global would be made anew
    for each task. Used only for tables of a bounded size; ``key[0]`` names
    the operator, and a worker that is reused by another lets go of them.
    """
    held = serve(key[0])
    if key not in held:
        held[key] = build()
    return held[key]


def serve(operator: str) -> dict:
    """The worker's store for one operator; that of any other is emptied."""
    store = sys.modules.setdefault("_graphlog_worker", types.ModuleType("_graphlog_worker")).__dict__
    if store.get("operator") != operator:
        store.update(operator=operator, held={})
        gc.collect()
    return store["held"]


def tidy(run: Callable) -> Callable:
    """``run`` over batches, after which the worker hands freed memory back.

    An idle worker stays for a minute, beside the workers of the next stage.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes of ``column``; a longer row stands alone."""
    start = size = 0
    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    for i, n in enumerate(pc.fill_null(lengths, 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows:
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1] drawn by the MD5 of the parts joined by ``/``; a null part reads as empty.

    Fifty-two bits, the same in any engine that has MD5 and doubles.
    """
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
