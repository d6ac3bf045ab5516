"""Ranked lexical search by range-maximum tables over posting lists.

The texts are read once for a block of items: per document its length and how
often it holds each term of the block. Documents are then dealt into segments
of a bounded number of postings. A segment lays its posting lists side by
side, sorted by term and document, and builds one sparse table over them, which
names the posting of greatest impact in any run of a list. A search keeps
intervals of documents; the sum of its terms' greatest impacts bounds every
score in an interval. The intervals of highest bound are taken first, a few at
a time: the document of greatest impact is scored and splits its interval in
two, each with its own bound. Intervals whose bound cannot reach the k-th score
found so far are dropped, so that the result is exact. The best k of every
segment meet in one ordered cut per item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from graphlog.llm.common import col, pieces, serve, tidy
from graphlog.storage import materialise

ITEM_BYTES = 16 << 20  # text of a block of items, whose terms every task holds
SEGMENT = 1 << 20  # postings of a segment
STEP = 256  # intervals split at a time
WINDOW = 1 << 20  # bytes of a long text looked at together


def _terms():
    """A text's terms, in pieces of bounded length."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
    table = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))

    def of(text: bytes | None) -> Iterator[list[bytes]]:
        data = (text or b"").translate(table)
        start = 0
        while len(data) - start > WINDOW:
            end = data.find(b" ", start + WINDOW)
            if end < 0:
                break
            yield data[start:end].split()
            start = end
        yield data[start:].split()

    return of


def _count(vocabulary):
    """Arrow batches of (id, text) -> (id, row, n, slots, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from pyspark import TaskContext

        serve("search")
        terms, slot = _terms(), vocabulary.value
        row = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            lengths, found = [], []
            for text in batch.column(1).to_pylist():
                n, held = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    held.update(map(slot.get, part))
                held.pop(None, None)
                lengths.append(n)
                found.append(held)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            slots = pa.array([t for held in found for t in held], pa.int32())
            often = pa.array([c for held in found for c in held.values()], pa.int32())
            made = [pa.array(np.arange(row, row + len(found))), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, slots), pa.ListArray.from_arrays(ends, often)]
            row += len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["_id", "_row", "_n", "_slots", "_tf"])

    return run


class Segment:
    """Posting lists (term slot, document, impact) under one sparse table of range maxima.

    Documents are numbered in the order in which equal scores rank.
    """

    def __init__(self, slots: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int, terms: int):
        order = np.lexsort((docs, slots))
        slots, self.docs, self.impacts = slots[order], docs[order], impacts[order]
        self.size = size
        self.keys = slots.astype(np.int64) * size + self.docs
        self.bounds = np.searchsorted(slots, np.arange(terms + 1))
        longest = int(np.diff(self.bounds).max(initial=0))
        best = np.arange(len(slots), dtype=np.int32)
        levels = [best]  # level j, place i: the posting of greatest impact in i .. i + 2**j - 1
        for j in range(1, longest.bit_length()):
            a, b = best[:-(1 << (j - 1))], best[1 << (j - 1):]
            best = np.where(self.impacts[a] >= self.impacts[b], a, b)
            levels.append(best)
        self.table = np.concatenate(levels)
        self.level = np.cumsum([0, *map(len, levels[:-1])])
        self.log = np.zeros(longest + 1, np.int8)
        for j in range(1, longest.bit_length()):
            self.log[1 << j:] = j

    def _peaks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact of each run a..b-1 and its posting; 0 for an empty run."""
        peak, at = np.zeros(a.shape, np.int64), np.zeros(a.shape, np.int32)
        full = b > a
        a, b = a[full], b[full]
        level = self.log[b - a]
        x, y = self.table[self.level[level] + a], self.table[self.level[level] + b - (1 << level.astype(np.int64))]
        first, second = self.impacts[x], self.impacts[y]
        at[full], peak[full] = np.where(first >= second, x, y), np.maximum(first, second)
        return peak, at

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, highest first, ties by number; all of them if fewer."""
        terms = terms[self.bounds[terms + 1] > self.bounds[terms]]
        base = terms.astype(np.int64) * self.size
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return found, scores

        def intervals(low, a, b):
            peak, at = self._peaks(a, b)
            top = peak.argmax(axis=1)
            split = self.docs[at[np.arange(len(at)), top]].astype(np.int64)
            return [x[peak.sum(axis=1) > 0] for x in (low, a, b, peak.sum(axis=1), split)]

        open_ = intervals(np.zeros(1, np.int64), self.bounds[terms][None, :], self.bounds[terms + 1][None, :])
        while len(open_[0]):
            if len(found) == k:  # what could still be among the best
                live = (open_[3] > scores[-1]) | ((open_[3] == scores[-1]) & (open_[0] < found[-1]))
                open_ = [x[live] for x in open_]
                if not len(open_[0]):
                    break
            first = np.arange(len(open_[3])) if len(open_[3]) <= STEP else np.argpartition(-open_[3], STEP)[:STEP]
            low, a, b, _, split = (x[first] for x in open_)
            rest = [np.delete(x, first, axis=0) for x in open_]
            keys = base[None, :] + split[:, None]
            at = np.searchsorted(self.keys, keys)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            score = np.where(hit, self.impacts[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1)
            found, scores = np.concatenate([found, split]), np.concatenate([scores, score])
            order = np.lexsort((found, -scores))[:k]
            found, scores = found[order], scores[order]
            halves = intervals(np.concatenate([low, split + 1]), np.concatenate([a, at + hit]), np.concatenate([at, b]))
            open_ = [np.concatenate(x) for x in zip(rest, halves, strict=True)]
        return found, scores


def _segment(batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[pa.Array, Segment]:
    """The ids of a segment's documents in order of id, nulls last, and its posting lists."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    whole = whole.take(pc.sort_indices(whole, sort_keys=[("_id", "ascending"), ("_row", "ascending")], null_placement="at_end"))
    slots = whole.column("_slots").combine_chunks()
    n = np.diff(slots.offsets.to_numpy())
    docs = np.repeat(np.arange(len(n), dtype=np.int32), n)
    m = np.array([100 - 50 + (50 * x * n_docs) // n_terms for x in whole.column("_n").to_pylist()], np.int64)
    slots = slots.flatten().to_numpy()
    tf = whole.column("_tf").combine_chunks().flatten().to_numpy().astype(np.int64)
    impacts = weights[slots] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
    some = impacts > 0
    return whole.column("_id").combine_chunks(), Segment(slots[some], docs[some], impacts[some], max(1, len(n)), len(weights))


def _find(queries, k: int, n_docs: int, n_terms: int):
    """The batches of one segment -> (item, id, score): its k best for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("search")
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items, weights = queries.value
        ids, segment = _segment(held, weights, n_docs, n_terms)
        held.clear()
        for no, terms in enumerate(items):
            docs, scores = segment.best(terms, k)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), no, np.int32)), ids.take(pa.array(docs)), pa.array(scores)], names=["_no", "_id", "_score"])

    return run


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    held = items.toArrow()
    split = _terms()
    named = [{t for part in split(x) for t in part} for x in held.column("_text").to_pylist()]
    slot = {t: i for i, t in enumerate(sorted(set().union(*named)))}
    if not slot:
        return None
    schema = docs.drop("_text").schema.add("_row", "long").add("_n", "long").add("_slots", ArrayType(IntegerType())).add("_tf", ArrayType(IntegerType()))
    made = materialise(docs.mapInArrow(tidy(_count(spark.sparkContext.broadcast(slot))), schema))
    n_docs, n_terms, postings = made.agg(F.count_if(F.col("_n") > 0), F.sum("_n"), F.sum(F.size("_slots"))).first()
    if not postings:
        return None
    df = np.zeros(len(slot), np.int64)
    for t, n in made.select(F.explode("_slots").alias("t")).groupBy("t").count().collect():  # one row per term of the block
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)
    queries = [np.array(sorted(slot[t] for t in terms if weights[slot[t]] > 0), np.int64) for terms in named]
    segments = -(-postings // SEGMENT)
    dealt = made.filter(F.size("_slots") > 0).repartitionById(segments, F.pmod(F.xxhash64("_row"), F.lit(segments)).cast("int"))
    task = _find(spark.sparkContext.broadcast((queries, weights)), k, n_docs, n_terms)
    found = dealt.mapInArrow(tidy(task), made.select(F.lit(0).alias("_no"), "_id", F.lit(0).cast("long").alias("_score")).schema)
    one = spark.createDataFrame(pa.table({"_no": pa.array(range(len(held)), pa.int32()), "_item": held.column("_item")}))
    place = F.row_number().over(Window.partitionBy("_no").orderBy(F.desc("_score"), F.asc_nulls_last("_id")))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(F.broadcast(one), "_no").select("_item", "rank", "_id", "_score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for each item, ties by smaller id, null ids last.

    A term is a run of letters and digits, only A-Z lowered. Every row of
    ``docs`` is a document, repeated ids too; null and empty texts have no
    terms, count nowhere and are never found. Repeated rows of an item are one
    item; items of one id and different texts are searched apart; an item of
    no known term has no row, and an empty table on either side gives none.
    Other columns are not read. Items are taken in blocks of ``ITEM_BYTES``,
    whose terms are broadcast, with one reading of the documents each.
    """
    slim = docs.select(col(id_column).alias("_id"), col(text).cast("binary").alias("_text"))
    asked = items.select(col(item_column).alias("_item"), col(item_text).cast("binary").alias("_text")).filter("_text IS NOT NULL").distinct()
    schema = StructType([asked.schema["_item"], StructField("rank", IntegerType()), slim.schema["_id"], StructField("_score", LongType())])
    total = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)
    parts = [asked.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b) for b in range(blocks)]
    found = [x for x in (_block(slim, part, k) for part in parts) if x is not None]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("_item").alias(item_column), "rank", F.col("_id").alias(id_column), F.col("_score").alias("score"))


#: The ranking in DuckDB: the same rules over all documents.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    i AS (SELECT row_number() OVER () AS no, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    q AS (SELECT DISTINCT no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
    s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, coalesce(sum(len(terms)), 0)::BIGINT AS n_terms FROM d),
    t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
    f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
    r AS (SELECT q.no, t.rid, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * len(d.terms) * s.n_docs) // s.n_terms))))::BIGINT AS score
        FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (rid), s GROUP BY q.no, t.rid),
    k AS (SELECT r.*, d.doc_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r JOIN d USING (rid) WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k JOIN i USING (no) WHERE rank <= 50"""
