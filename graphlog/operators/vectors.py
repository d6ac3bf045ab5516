"""An inverted file over vectors: centres, cells, probes, exact re-ranking.

``resolve.nearest`` compares every query with every vector. Here vectors are
dealt into the cells of centres trained on a bounded sample, a query meets the
cells of its nearest centres only, and what it meets is ranked by the exact
cosine. Every vector is indexed. A cell of any size is searched in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from graphlog.operators import resolve
from graphlog.operators.resolve import _NEAR, BLOCK_BYTES, NEIGHBOURS, _score, _unit
from graphlog.storage import materialise

PROBES = 8
#: Rows of the training sample per centre; the sample is the driver's only copy of any vector.
SAMPLE = 64
ROUNDS = 10


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = pc.fill_null(vectors.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(np.nan_to_num(flat, posinf=0.0, neginf=0.0).reshape(-1, width))


def train(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """``cells`` unit centres by spherical k-means over at most ``cells * sample`` vectors.

    The sample is that of the smallest hashes of tenant and node, so it does
    not depend on the order of rows. Vectors of the sample's commonest width
    are used; none at all gives no centres.
    """
    some = vectors.filter("vector IS NOT NULL AND size(vector) > 0").orderBy(F.xxhash64("model_id", "node")).limit(cells * sample)
    held = some.select("vector").toArrow().column("vector").combine_chunks()
    if not len(held):
        return np.zeros((0, 0))
    widths = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    width = int(np.bincount(widths).argmax())
    rows = _matrix(held.filter(pa.array(widths == width)), width)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lost = np.bincount(own, minlength=len(centres)) == 0
        centres = np.where(lost[:, None], centres, _unit(sums))
    return centres


def _cells(centres: np.ndarray, most: int):
    """Batches with ``vector`` -> the same with ``cells``: the nearest centres, or -1 for a vector of another width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centres.shape[1]
        for batch in batches:
            vectors = batch.column("vector")
            fits = pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == width
            out: list = [[-1]] * batch.num_rows
            if width and fits.any():
                near = _matrix(vectors.filter(pa.array(fits)), width) @ centres.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :most]
                for i, row in zip(np.flatnonzero(fits).tolist(), top.tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def _placed(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    schema = StructType([*rows.schema, StructField("cells", ArrayType(IntegerType()))])
    return rows.mapInArrow(_cells(centres, most), schema).withColumn("cell", F.explode("cells")).drop("cells")


def index(vectors: DataFrame, centres: np.ndarray, model: str | None = None) -> DataFrame:
    """(model_id, node, vector, cell), written by cell: every vector in the cell of its nearest centre.

    Vectors of another width than the centres are cell -1, which queries of
    such a width search whole. Null vectors are left out.
    """
    if model is not None and "embedding_model" in vectors.columns:
        vectors = vectors.filter(F.col("embedding_model") == model)
    rows = vectors.filter(F.col("vector").isNotNull()).select("model_id", "node", "vector")
    return materialise(_placed(rows, centres, 1).repartition("cell").sortWithinPartitions("cell"))


def probe(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int = NEIGHBOURS, probes: int = PROBES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(model_id, query_id, node, score, rank): the k nearest by cosine among the cells of each query's ``probes`` nearest centres.

    Scores are exact and ties go by node, as in ``resolve.nearest``; with as
    many probes as centres the result is the same. Fewer may miss neighbours:
    measure the recall on your vectors.
    """
    asked = queries.filter(F.col("vector").isNotNull()).select("model_id", "query_id", "vector")
    keys = ["model_id", "width", "cell"]

    def dealt(rows: DataFrame, name: str, block: str, blocks: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumn("width", F.size("vector"))
        per = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.greatest("width", F.lit(1)))))
        counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(blocks))
        return rows.join(counts, keys).withColumn(block, F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")).drop(blocks), counts

    known, known_blocks = dealt(indexed, "node", "block", "blocks")
    wanted, wanted_parts = dealt(materialise(_placed(asked, centres, probes)), "query_id", "part", "parts")

    def to_all(rows: DataFrame, counts: DataFrame, blocks: str, block: str) -> DataFrame:
        return rows.join(counts, keys).withColumn(block, F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).drop(blocks)

    order = [*keys, "block", "part"]
    left = to_all(known, wanted_parts, "parts", "part")  # only cells that a query probes
    right = to_all(wanted, known_blocks, "blocks", "block").withColumnRenamed("vector", "q")
    right = right.select(*[F.col(c).alias(f"_{c}") for c in order], "query_id", "q")
    found = left.groupBy(*order).cogroup(right.groupBy(*[f"_{c}" for c in order])).applyInArrow(_score(k), _NEAR)
    ranked = Window.partitionBy("model_id", "query_id").orderBy(F.desc("score"), "node")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def calibrate(queries: DataFrame, vectors: DataFrame, indexed: DataFrame, centres: np.ndarray, recall: float = 0.9, k: int = NEIGHBOURS) -> tuple[int, float]:
    """(probes, recall): the fewest probes at which the queries' exact neighbours are found so often.

    The exact neighbours' cells are looked up in each query's order of
    centres; what comes to the driver is one count per place in that order.
    Vectors without clusters need probes of about half the cells.
    """
    asked = queries.filter(F.col("vector").isNotNull()).select("model_id", "query_id", "vector")
    schema = StructType([*asked.schema, StructField("cells", ArrayType(IntegerType()))])
    ordered = asked.mapInArrow(_cells(centres, max(1, len(centres))), schema).select("model_id", "query_id", F.posexplode("cells").alias("place", "cell"))
    true = resolve.nearest(asked, vectors, k).select("model_id", "query_id", "node").join(indexed.select("model_id", "node", "cell"), ["model_id", "node"])
    placed = true.join(ordered, ["model_id", "query_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.place: r.n for r in placed.collect()}
    total, upto = sum(counts.values()), 0
    for place in range(max(1, len(centres))):
        upto += counts.get(place, 0)
        if upto >= recall * total:
            break
    return place + 1, upto / total if total else 1.0
