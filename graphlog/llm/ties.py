"""Connected components of links too many for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlog.storage import materialise


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node each node is connected with.

    Alternates large and small stars, written out each time, until no edge
    changes; the rounds grow with the logarithm of the longest path. A hub is
    only ever the key of a ``min`` and of an equi-join, both of which split.
    """
    now = materialise(
        edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).filter("u <> v").distinct()
    )

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = near.join(low, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        code = F.xxhash64("u", "v")
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1 << 31)))).first())

    seen = mark(now)
    while seen[0]:
        now = materialise(star(star(now, True), False))
        was, seen = seen, mark(now)
        if was == seen:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
