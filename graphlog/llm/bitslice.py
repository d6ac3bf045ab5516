"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers and stored in blocks; in a block every
attribute is a stack of bitmaps, one per bit. For a query the high bits of the
attributes are added up, weighted by the query, with bitmap logic alone (full
adders over words of 64 rows), which gives the coarse score of all rows as
another stack of bitmaps. Walking that stack from its most significant slice
down finds the k-th best coarse score. What the low bits can add or take away
is known, so rows that reach the k-th best minus that margin are a superset of
the answer; only these boundary rows are scored exactly.

Blocks of rows meet blocks of queries as equi-joined groups of a fixed size,
each its own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.llm.common import col
from graphlog.storage import materialise

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 128
LOW_BITS = 4  # bits of an attribute left to the exact step
QUERY_LOW_BITS = 3
_INDEX = "dims int, block int, ids binary, low binary, slices binary, bits binary, values binary, width int"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    ok = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(ok, F.lit(False)), F.transform(numbers, lambda x: F.floor(x * scale)))


def _bitmaps(rows: np.ndarray) -> np.ndarray:
    """Booleans [.., n] as words [.., ceil(n / 64)]."""
    pad = -rows.shape[-1] % 64
    rows = np.pad(rows, [(0, 0)] * (rows.ndim - 1) + [(0, pad)])
    return np.packbits(rows, axis=-1, bitorder="little").view(np.uint64)


def _slice_block(key: tuple, table: pa.Table) -> pa.Table:
    dims, block = key[0].as_py(), key[1].as_py()
    ids = table.column("id").to_numpy().astype(np.int64)
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dims)
    low = values.min(axis=0) if dims else np.zeros(0, np.int64)
    coarse = ((values - low) >> LOW_BITS).T
    bits = np.array([int(c.max()).bit_length() for c in coarse], np.int64)
    maps = [_bitmaps(((c[None, :] >> np.arange(b)[:, None]) & 1).astype(bool)) for c, b in zip(coarse, bits, strict=True)]
    words = -(-len(ids) // 64)
    slices = np.concatenate(maps) if maps else np.zeros((0, words), np.uint64)
    kind = next(k for k in (np.int16, np.int32, np.int64) if not values.size or (np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max))
    row = [dims, block, ids.tobytes(), low.tobytes(), slices.tobytes(), bits.tobytes(), values.astype(kind).tobytes(), kind().itemsize]
    names = ["dims", "block", "ids", "low", "slices", "bits", "values", "width"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)


def index(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of vectors of equal length: ids, bitmaps of the high bits, whole values."""
    rows = materialise(vectors.select(col(id_column).cast("long").alias("id"), quantised(col(vector), scale).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL").withColumn("dims", F.size("v")))
    blocks = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n"))
    # dealt by hash: blocks are equal in expectation, whatever the order of the ids
    dealt = rows.join(blocks, "dims").select("dims", F.pmod(F.xxhash64("id", "v"), F.col("n")).cast("int").alias("block"), "id", "v")
    return dealt.groupBy("dims", "block").applyInArrow(_slice_block, _INDEX)


def _add(stack: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight -> one bitmap per bit of the sum, lowest first."""
    out = []
    at = 0
    while stack:
        rows = stack.pop(at, None)
        if rows is None:
            out.append(None)
            at += 1
            continue
        rows = np.concatenate(rows)
        while len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k:2 * k], rows[2 * k:3 * k]
                half = a ^ b
                stack.setdefault(at + 1, []).append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * k:]])
            else:
                stack.setdefault(at + 1, []).append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
        at += 1
    return out


def _digits(n: int) -> list[tuple[int, int]]:
    """(power, sign) of the signed binary digits of n, no two neighbours."""
    out, power = [], 0
    while n:
        if n & 1:
            sign = 2 - (n & 3)
            out.append((power, sign))
            n -= sign
        n >>= 1
        power += 1
    return out


class _Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n, dims = len(self.ids), row["dims"]
        self.low = np.frombuffer(row["low"], np.int64)
        bits = np.frombuffer(row["bits"], np.int64)
        words = -(-n // 64)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, words)
        self.slices = np.split(slices, np.cumsum(bits)[:-1]) if dims else []
        self.values = np.frombuffer(row["values"], f"i{row['width']}").reshape(n, dims)
        whole = self.values.astype(np.int64)
        self.most = whole.max(axis=0) if dims else np.zeros(0, np.int64)
        self.size = np.abs(whole).max(axis=0) if dims else np.zeros(0, np.int64)
        self.full = _bitmaps(np.ones(n, bool))

    def best(self, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the block but the query's own, ties to the smaller id."""
        alive = self.full & ~_bitmaps(self.ids == query)
        safe = int(self.size.astype(object).dot(np.abs(vector).astype(object))) < 1 << 60 if len(vector) else True
        if safe:
            alive = self._boundary(vector, alive, k)
        rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[: len(self.ids)])
        chosen = self.values[rows].astype(np.int64 if safe else object)
        scores = chosen @ vector.astype(chosen.dtype) if len(vector) else np.zeros(len(rows), np.int64)
        if not safe:  # beyond a long: held to its range, as a score must be one
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores], np.int64)
            order = np.array(sorted(range(len(rows)), key=lambda i: (-int(scores[i]), int(self.ids[rows[i]])))[:k], np.int64)
        else:
            order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order].astype(np.int64)

    def _boundary(self, vector: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        half = 1 << (QUERY_LOW_BITS - 1)
        high = (vector + half) >> QUERY_LOW_BITS
        stack: dict[int, list[np.ndarray]] = {}
        for q, slices in zip(high.tolist(), self.slices, strict=True):
            for power, sign in _digits(q):
                for b in range(len(slices)):
                    stack.setdefault(power + b, []).append(slices[b:b + 1] if sign > 0 else ~slices[b:b + 1])
        # a negative digit adds the complement: off by the same constant in every row
        total = _add(stack)
        # score = constant + 2^unit * total + a part of the low bits of query and attributes
        # that differs by at most ``margin`` between two rows
        unit = QUERY_LOW_BITS + LOW_BITS
        rest = np.abs(vector - (high << QUERY_LOW_BITS)) * (self.most - self.low)
        margin = int(rest.sum()) + ((1 << LOW_BITS) - 1) * int(np.abs(vector).sum())
        equal, need, level = alive, min(k, int(np.bitwise_count(alive).sum())), 0
        if not need:
            return alive
        for i in range(len(total) - 1, -1, -1):
            if total[i] is None:
                continue
            ones = equal & total[i]
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                equal, level = ones, level | 1 << i
            else:
                equal, need = equal & ~total[i], need - count
        floor = max(0, level - -(-margin // (1 << unit)))
        above, equal = np.zeros_like(alive), alive
        for i in range(max(len(total), floor.bit_length()) - 1, -1, -1):
            bitmap = total[i] if i < len(total) and total[i] is not None else np.zeros_like(alive)
            if floor >> i & 1:
                equal = equal & bitmap
            else:
                above, equal = above | (equal & bitmap), equal & ~bitmap
        return above | equal


def _search(k: int):
    def run(key: tuple, blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if blocks.num_rows and queries.num_rows:
            asked = queries.column("qid").to_numpy()
            dims = key[0].as_py()
            vectors = queries.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(asked), dims)
            for row in blocks.to_pylist():
                block = _Block(row)
                for q, vector in zip(asked.tolist(), vectors, strict=True):
                    ids, scores = block.best(q, vector, k)
                    found.append((np.full(len(ids), q, np.int64), ids, scores))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=["query_id", "id", "score"])

    return run


def top_k(queries: DataFrame, blocks: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k rows of greatest integer inner product with each query.

    ``blocks`` comes from :func:`index`. Rows of the query's own id are left
    out, and so are vectors of another length, or null or not finite ones.
    Ties go to the smaller id; a repeated query counts once. Fewer rows than k
    give them all.
    """
    blocks = materialise(blocks)
    asked = queries.select(col(id_column).cast("long").alias("qid"), quantised(col(vector), scale).alias("q")).filter("q IS NOT NULL AND qid IS NOT NULL").distinct()
    asked = materialise(asked.withColumn("dims", F.size("q")))
    parts = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("parts"))
    left = blocks.join(parts, "dims").select(*blocks.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = asked.join(parts, "dims").withColumn("part", F.pmod(F.xxhash64("qid", "q"), F.col("parts")).cast("int"))
    right = dealt.join(blocks.select("dims", "block"), "dims").select(F.col("dims").alias("_d"), F.col("block").alias("_b"), F.col("part").alias("_p"), "qid", "q")
    found = left.groupBy("dims", "block", "part").cogroup(right.groupBy("_d", "_b", "_p")).applyInArrow(_search(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # rows of one id in several blocks: each is a candidate of its own
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id"), "score")
