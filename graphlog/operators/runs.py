"""Running values over ordered groups when one group may be huge.

A plain window sends a whole group to one task. Here a group above
``chunk`` rows is cut by its order key, each piece is scanned on its own, and
the result of the pieces before is joined in. Groups below the limit keep one
piece and cost one ordinary window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.model import CHUNK_ROWS
from graphlog.storage import materialise


def large_groups(df: DataFrame, by: list[str], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Keys of the groups above ``chunk`` rows: at most rows/chunk of them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select(*by)


def in_pieces(
    df: DataFrame, by: list[str], order: str, chunk: int = CHUNK_ROWS, large: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows of large groups), both with ``_piece``.

    ``_piece`` is 0, or the slice of the order key for a large group. ``order``
    is a whole number unique within the group, so a slice holds at most
    ``chunk`` rows. ``large`` may name the large groups of a coarser key found
    before. The second frame is an inner join, so that adaptive execution
    drops everything built on it when no group is large.
    """
    if large is None:
        large = large_groups(df, by, chunk)
    keys = [c for c in by if c in large.columns]
    slice_of = F.expr(f"CAST(`{order}` div {int(chunk)} AS BIGINT) + 1")
    mark = F.broadcast(large.select(*keys).withColumn("_large", F.lit(True)))
    piece = F.when(F.col("_large"), slice_of).otherwise(F.lit(0).cast("long"))
    rows = df.join(mark, keys, "left").withColumn("_piece", piece).drop("_large")
    hot = df.join(mark, keys).withColumn("_piece", slice_of).drop("_large")
    return rows, hot


def running(
    df: DataFrame,
    by: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk: int = CHUNK_ROWS,
    large: DataFrame | None = None,
) -> DataFrame:
    """Add running ``first`` or ``last`` (non-null), ``min``, ``max`` or ``sum`` columns.

    ``values`` maps an output name to (kind, expression). Without
    ``inclusive`` a row sees only the rows before it.
    """
    names = list(values)
    inputs = df.select("*", *[values[n][1].alias(f"_in_{n}") for n in names])
    pieces, hot = in_pieces(inputs, by, order, chunk, large)
    key = by + ["_piece"]

    inside = Window.partitionBy(*key).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, column: Column, window) -> Column:
        if kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        if kind == "first":
            return F.first(column, ignorenulls=True).over(window)
        return {"min": F.min, "max": F.max, "sum": F.sum}[kind](column).over(window)

    def whole(kind: str, column: Column) -> Column:
        if kind == "last":
            return F.max_by(column, F.when(column.isNotNull(), F.col(order)))
        if kind == "first":
            return F.min_by(column, F.when(column.isNotNull(), F.col(order)))
        return {"min": F.min, "max": F.max, "sum": F.sum}[kind](column)

    def combine(kind: str, inner: Column, carried: Column) -> Column:
        if kind == "last":
            return F.coalesce(inner, carried)
        if kind == "first":
            return F.coalesce(carried, inner)
        if kind == "sum":
            return F.coalesce(inner + carried, inner, carried)
        return (F.least if kind == "min" else F.greatest)(inner, carried)

    totals = hot.groupBy(*key).agg(*[whole(values[n][0], F.col(f"_in_{n}")).alias(f"_all_{n}") for n in names])
    carried = totals.select(*key, *[over(values[n][0], F.col(f"_all_{n}"), before).alias(f"_pre_{n}") for n in names])
    scanned = pieces.select("*", *[over(values[n][0], F.col(f"_in_{n}"), inside).alias(f"_run_{n}") for n in names])
    joined = scanned.join(carried, key, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[combine(values[n][0], F.col(f"_run_{n}"), F.col(f"_pre_{n}")).alias(n) for n in names],
    )


def ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Total order by range partition, with the partition written as ``_range``.

    Range bounds are sampled, so they are fixed by writing the rows out: any
    key, however large, is spread over as many ranges as its rows need.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    return materialise(sliced)


def numbered(
    df: DataFrame, tenant: str, order: list[str], out: str = "seq", start: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Dense per-tenant numbers in ``order``; ``start(tenant, last)`` continues.

    Counts per range come first, then each range numbers its own rows from
    the count before it, so that no tenant needs a task to itself.
    """
    rows = ranges(df, [tenant], order, parts)
    counts = rows.groupBy(tenant, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(tenant).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tenant, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    if start is not None:
        last = start.select(tenant, F.col("last").alias("_last"))
        offsets = offsets.join(last, tenant, "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce(F.col("_last"), F.lit(0))
        )
    inside = Window.partitionBy(tenant, "_range").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(offsets.select(tenant, "_range", "_offset"), [tenant, "_range"])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_rank")).cast("long").alias(out))
