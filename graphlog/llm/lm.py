"""Stupid-backoff scores from n-gram count tables.

Words and bigrams are counted in one shuffle. A task hashes a slice of
documents and sorts the hashes once; each bucket of hashes gets the slice's
distinct n-grams and how often each occurs. A bucket adds up the counts of all
slices, which is its part of the count table, and answers every slice that
asked with the totals of its n-grams, in order. The slice's texts travel beside
them, compressed, and meet the answers in one task, which joins them to the
occurrences and sums per document.

A text is scored under the counts of all the other texts: what it adds to a
count itself is taken off again, so that a bigram found nowhere else backs off.

An n-gram that makes up a good part of all text would have a count from every
slice in one bucket. The frequent ones (at most ``FREQUENT`` of them, named by
the first slice of every partition, which decides nothing but the route) are
counted exactly in a pass of their own; that table has a fixed bound, is
broadcast, and their counts never move.

The score of a text w1..wn is the sum of ln S: S(w1) = C(w1) / N and
S(w | v) = C(v w) / C(v) if the bigram was seen, else alpha * C(w) / N; a word
that was never seen counts as seen once, and so does N if nothing else is left.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlog.llm.common import WORD, col, serve, spread, tidy

SLICE_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
SENT = 4 << 20  # bytes of answers a task gathers before it sends them
FREQUENT = 2048
#: n: 1 or 2 for packed n-grams and their totals, 0 for a slice's ids and texts; batch -1 asks for nothing
_ROW = "batch long, n int, bucket int, width int, hashes binary, counts binary, ids array<string>, sizes binary, text binary"


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [x.strip().split(" ") for x in _ROW.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, so that a batch of long ones is not copied whole."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about ``SLICE_BYTES``, at most 65536 rows; a longer text stands alone."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start = size = 0
        for i, n in enumerate([*pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES + 1]):
            if i > start and (size + n > SLICE_BYTES or i - start == 1 << 16):
                yield ids.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n


class _Hashed:
    """Words of a slice as hashes, with the document and place of each."""

    def __init__(self, texts: list, known):
        import re

        find = re.compile(WORD).findall
        words = [find(t or "") for t in texts]
        self.sizes = sizes = np.array([len(w) for w in words], np.int64)
        self.h = h = np.fromiter((x for w in words for x in map(known, w)), np.uint64, int(sizes.sum()))
        self.doc = np.repeat(np.arange(len(words)), sizes)
        self.first = np.zeros(len(h), bool)
        self.first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        both = ~self.first[1:]
        left, right, self.pair_doc = h[:-1][both], h[1:][both], self.doc[:-1][both]
        x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019) + (left << np.uint64(6)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.pair = x ^ (x >> np.uint64(29))


def _known():
    import xxhash

    serve("lm")

    class Hashes(dict):
        def __missing__(self, word: str) -> int:
            if len(self) > 200_000:
                self.clear()
            h = self[word] = xxhash.xxh64_intdigest(word.encode(), 1)
            return h

    return Hashes().__getitem__


def _usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n, total): the most frequent words and bigrams of a partition's first slice."""
    known = _known()
    for _, texts in _slices(batches):
        slice_ = _Hashed(texts, known)
        for n, h in ((1, slice_.h), (2, slice_.pair)):
            uniq, counts = np.unique(h, return_counts=True)
            top = np.argsort(-counts, kind="stable")[:FREQUENT]
            yield _counts(n, uniq[top], counts[top])
        return


def _count(frequent: np.ndarray):
    """(hash, n, total) of the given n-grams; n is 0 for words and 3 for bytes in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        words = size = 0
        totals: dict[int, np.ndarray] = {}
        for _, texts in _slices(batches):
            slice_ = _Hashed(texts, known)
            words += len(slice_.h)
            size += sum(len(t.encode()) for t in texts if t)
            for n, h in ((1, slice_.h), (2, slice_.pair)):
                at, hit = _among(frequent, h)
                totals[n] = totals.get(n, 0) + np.bincount(at[hit], minlength=len(frequent))
        for n, t in totals.items():
            yield _counts(n, frequent, t)
        yield _counts(0, np.zeros(1, np.uint64), np.array([words]))
        yield _counts(3, np.zeros(1, np.uint64), np.array([size]))

    return run


def _among(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _counts(n: int, h: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(total.astype(np.int64))], names=["h", "n", "total"])


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones, ...: the shuffle's compression finds the zeros."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(h: np.ndarray) -> bytes:
    """Sorted hashes by their differences, which are small."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Order of hashes is order of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(frequent: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a slice that travel, in order, and their counts."""
    uniq, counts = np.unique(h, return_counts=True)
    rare = ~_among(frequent, uniq)[1]
    return uniq[rare], counts[rare]


def _pack(buckets: int, counted: bool, asked: bool, frequent):
    """Slices of (id, text) -> distinct words and bigrams by bucket; the slice's ids and texts if it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = _known()
        batch = TaskContext.get().partitionId() << 32
        for ids, texts in _slices(batches):
            key = {"batch": batch if asked else -1}
            s = _Hashed(texts, known)
            rows = []
            for n, h in ((1, s.h), (2, s.pair)):
                uniq, counts = _distinct(frequent.value[0], h)
                bucket = _bucket(uniq, buckets)
                cuts = [*np.flatnonzero(np.concatenate((np.ones(min(1, len(uniq)), bool), bucket[1:] != bucket[:-1]))).tolist(), len(uniq)]
                for a, b in itertools.pairwise(cuts):
                    told = _planes(counts[a:b].astype(np.uint32)) if counted else None
                    rows.append(key | {"n": n, "bucket": int(bucket[a]), "hashes": _steps(uniq[a:b]), "counts": told})
            if asked:
                raw = [(t or "").encode() for t in texts]
                sizes = np.array([len(t) for t in raw], np.int64).tobytes()
                text = pa.compress(b"".join(raw), codec="zstd", asbytes=True)
                rows.append(key | {"n": 0, "bucket": batch % buckets, "ids": ids, "sizes": sizes, "text": text})
            yield _rows(rows)
            batch += 1

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, n): each bucket's counts added up, and the totals each slice asked for."""
    held: list[dict] = []
    at = None

    def close() -> Iterator[dict]:
        hashes = [np.cumsum(_values(r["hashes"], "u8"), dtype=np.uint64) for r in held]
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = [_values(r["counts"], "u4") if r["counts"] is not None else np.zeros(len(h)) for r, h in zip(held, hashes, strict=True)]
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.uint64)
        width = 4 if total.max() < 1 << 32 else 8
        total = total.astype(f"u{width}")
        done = 0
        for r, h in zip(held, hashes, strict=True):
            mine = where[done:done + len(h)]
            done += len(h)
            if r["batch"] >= 0:
                yield {"batch": r["batch"], "n": r["n"], "bucket": r["bucket"], "width": width, "counts": _planes(total[mine])}
        held.clear()

    out: list[dict] = []
    size = 0
    for batch in batches:
        for r in _each(batch):
            if r["n"] == 0:
                yield _rows([r])
                continue
            if (r["bucket"], r["n"]) != at:
                for row in close() if held else ():
                    out.append(row)
                    size += len(row["counts"])
                    if size > SENT:
                        yield _rows(out)
                        out, size = [], 0
                at = (r["bucket"], r["n"])
            held.append(r)
    out += close() if held else []
    yield _rows(out)


def _score(words: int, own: bool, alpha: float, frequent):
    """Rows sorted by (batch, n, bucket): each slice's texts joined to their totals, a row per document.

    With ``own`` the counts hold the texts themselves, and each text's are
    taken off for it.
    """

    def totals(n: int, h: np.ndarray, doc: np.ndarray, told: list[np.ndarray]) -> np.ndarray:
        """C of each occurrence, as its document sees it."""
        common, exact = frequent.value
        uniq, where = np.unique(h, return_inverse=True)
        at, hit = _among(common, uniq)
        all_ = np.zeros(len(uniq), np.int64)
        answers = np.concatenate(told) if told else np.zeros(0, np.int64)
        if len(answers) != int((~hit).sum()):
            raise ValueError("a slice and its counts do not belong together")
        all_[~hit] = answers
        all_[hit] = exact[n][at[hit]]
        seen = all_[where]
        if own:
            _, mine, times = np.unique(where.astype(np.int64) << 16 | doc, return_inverse=True, return_counts=True)
            seen = seen - times[mine]
        return seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        now: dict | None = None
        told: dict[int, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            sizes = np.frombuffer(now["sizes"], np.int64)
            ends = np.cumsum(sizes)
            raw = pa.decompress(now["text"], decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
            s = _Hashed([raw[b - n:b].decode() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)], known)
            one, two = totals(1, s.h, s.doc, told[1]), totals(2, s.pair, s.pair_doc, told[2])
            left = np.maximum(1, words - s.sizes) if own else np.full(len(s.sizes), max(1, words))
            alone = np.log(np.maximum(one, 1)) - np.log(left)[s.doc]
            worth = np.where(s.first, alone, alone + math.log(alpha))
            seen = two > 0
            later = np.flatnonzero(~s.first)[seen]
            worth[later] = np.log(two[seen]) - np.log(one[later - 1])
            made = np.bincount(s.doc, weights=worth, minlength=len(s.sizes)).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array(now["ids"], pa.string()), pa.array(s.sizes), pa.array(made)], names=["id", "words", "log_score"])

        for batch in batches:
            for r in _each(batch):
                if r["n"] == 0:
                    if now is not None:
                        yield out()
                    now, told = r, {1: [], 2: []}
                elif now is None or r["batch"] != now["batch"]:
                    raise ValueError("a slice and its counts do not belong together")
                else:
                    told[r["n"]].append(_values(r["counts"], f"u{r['width']}").astype(np.int64))
        if now is not None:
            yield out()

    return run


def score(docs: DataFrame, corpus: DataFrame | None = None, id_column: str = "doc_id", text: str = "text", alpha: float = 0.4) -> DataFrame:
    """(id, n_words, log_score) of each whole text of ``docs``, in nats, under the counts of ``corpus``.

    Without a corpus each row is scored under all other rows of ``docs``. No
    texts, no rows; a text without words, null or empty, scores 0. Repeated
    rows are counted and scored as often as they occur, so that one sees the
    others. ``id_column`` keeps its type; ids may be null or repeat.
    """
    spark = docs.sparkSession
    own = corpus is None
    kind = docs.schema[id_column].dataType

    def slim(df: DataFrame) -> DataFrame:
        label = col(id_column).cast("string") if df is docs else F.lit(None).cast("string")
        return df.select(label.alias("id"), col(text).cast("string").alias("text"))

    model = slim(docs if own else corpus)
    shape = "h long, n int, total long"
    usual = model.mapInArrow(_usual, shape).groupBy("h").agg(F.sum("total").alias("total"))
    names = [r[0] for r in usual.orderBy(F.desc("total"), "h").limit(FREQUENT).collect()]
    common = np.sort(np.array(names, np.int64).view(np.uint64))
    found = {(r[0], r[1]): r[2] for r in model.mapInArrow(_count(common), shape).groupBy("h", "n").agg(F.sum("total")).collect()}
    words, size = found.pop((0, 0), 0), found.pop((0, 3), 0)
    exact = {n: np.array([found.get((h, n), 0) for h in common.view(np.int64).tolist()], np.int64) for n in (1, 2)}
    frequent = spark.sparkContext.broadcast((common, exact))
    tasks = spread(spark)
    buckets = max(tasks, size // BUCKET_BYTES + 1)
    packs = slim(docs).mapInArrow(tidy(_pack(buckets, own, True, frequent)), _ROW)
    if not own:
        packs = packs.unionByName(model.mapInArrow(tidy(_pack(buckets, True, False, frequent)), _ROW))
    answers = packs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "n").mapInArrow(tidy(_total), _ROW)
    met = answers.repartition(tasks, "batch").sortWithinPartitions("batch", "n", "bucket")
    done = met.mapInArrow(tidy(_score(words, own, alpha, frequent)), "id string, words long, log_score double")
    return done.select(F.col("id").cast(kind).alias(id_column), F.col("words").alias("n_words"), "log_score")
