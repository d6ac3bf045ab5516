"""Long repeated passages, by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``width`` bytes covers it that also starts earlier.

A suffix array of every byte would be many times the text, so the arrays are
sparse: of each window of ``width`` bytes only its anchor is indexed, the
k-mer of the smallest hash in it. Equal windows have equal anchors at equal
places, so nothing is missed. The windows that share an anchor form a run; a
run's entry is (anchor, hash of all bytes the run covers, place), and entries
in that order are the sparse suffix array, hashes standing for the bytes.

Entries are dealt by anchor. In each bucket, batches of entries become suffix
arrays, are merge-scanned against the levels held so far, where equal
neighbours are long matches, and are kept as a new level; levels of like size
merge, so that there are logarithmically many. Runs that match as a whole are
settled there. Anchors that meet in different surroundings leave contested
runs; those are settled window by window, dealt by the window's own hash.

Before each shuffle a task settles what repeats within its own slice of the
documents, so that a passage in a third of them is one entry per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlog.llm.common import col, once, spread, tidy
from graphlog.storage import materialise

WIDTH = 100
SEED = 32  # bytes of the k-mers that anchors are chosen among
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
BATCH = 1 << 16
_LAST = (1 << 63) - 1
_ENTRY = np.dtype([("anchor", "u8"), ("hash", "u8"), ("id", "i8"), ("start", "i4"), ("part", "u4"), ("n", "u1")])
_ROW = "bucket int, id long, part int, contested boolean, starts binary, stops binary, entries binary"
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substrings of a buffer, from sums over its bytes."""

    def __init__(self, room: int):
        self.table = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.grow(room)

    def grow(self, room: int) -> None:
        self.up, self.down = np.full(room + 1, _BASE, np.uint64), np.full(room + 1, _BACK, np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


def runs(hasher: Hasher, data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, seed: int = SEED):
    """(start, windows, anchor, hash, place of the anchor): stretches of windows of ``width`` bytes that choose the same anchor.

    ``bounds`` are the ends of the documents in ``data``. The anchor of a
    window is its k-mer of the smallest hash, the leftmost of equal ones; so
    equal windows choose equal anchors at equal places.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    hasher.load(data)
    kmer = _mix((hasher.sums[seed:] - hasher.sums[:-seed]) * hasher.down[: n - seed + 1])
    place = np.uint64((1 << 24) - 1)
    low = (kmer & ~place) | np.arange(len(kmer), dtype=np.uint64)
    size, span = 1, width - seed + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    windows = n - width + 1
    low = np.minimum(low[:windows], low[span - size: span - size + windows]) & place
    inside = np.ones(windows + 1, bool)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(bounds - width + 1, np.concatenate(([0], bounds[:-1]))), 1)
    np.add.at(edge, bounds, -1)
    inside[:windows] = np.cumsum(edge[:windows]) == 0
    inside[windows] = False
    change = np.ones(windows, bool)
    change[1:] = (low[1:] != low[:-1]) | ~inside[: windows - 1]
    start = np.flatnonzero(change & inside[:windows])
    stop = np.flatnonzero(inside[:windows] & (np.concatenate((change[1:], [True])) | ~inside[1:]))
    at = low[start].astype(np.int64)
    return start, stop - start + 1, kmer[at], hasher.of(start, stop + width), at


def _planes(x: np.ndarray) -> bytes:
    """The bytes of all entries, first bytes first: like bytes side by side compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _entries(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(_ENTRY.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(_ENTRY).reshape(-1)


def _order(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x["part"], x["start"], x["id"], x["hash"], x["anchor"]))]


def _settle(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order: those whose run starts nowhere earlier, and those whose run does.

    An entry that is there twice counts once. Rows of one id and place are not
    earlier than each other.
    """
    if not len(x):
        return x, x
    new = np.ones(len(x), bool)
    new[1:] = (x["anchor"][1:] != x["anchor"][:-1]) | (x["hash"][1:] != x["hash"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (x["id"] != x["id"][first]) | (x["start"] != x["start"][first])
    again = np.zeros(len(x), bool)
    again[1:] = ~new[1:] & (x["id"][1:] == x["id"][:-1]) & (x["start"][1:] == x["start"][:-1]) & (x["part"][1:] == x["part"][:-1])
    return x[~later & ~again], x[later & ~again]


class Family:
    """Sorted levels of entries, each more than twice the next; no run is in two of them with different places."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> Iterator[np.ndarray]:
        """Take in a batch; yields the entries, new or held, that turn out to repeat earlier ones."""
        batch, repeats = _settle(_order(batch))
        yield repeats
        for i, level in enumerate(self.levels):
            # long matches are equal neighbours in the merged order; only those leave either side
            _, repeats = _settle(_order(np.concatenate([level, batch])))
            if len(repeats):
                yield repeats
                self.levels[i] = level[~_among(level, repeats)]
                batch = batch[~_among(batch, repeats)]
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels[-2:] = [_settle(_order(np.concatenate(self.levels[-2:])))[0]]

    def contested(self) -> np.ndarray:
        """Entries of anchors that are held with more than one run."""
        if not self.levels:
            return np.zeros(0, _ENTRY)
        x, _ = _settle(_order(np.concatenate(self.levels)))
        if not len(x):
            return x
        new = np.concatenate(([True], x["anchor"][1:] != x["anchor"][:-1]))
        group = np.cumsum(new) - 1
        differs = np.concatenate(([False], (x["hash"][1:] != x["hash"][:-1]) & ~new[1:]))
        return x[(np.bincount(group, weights=differs) > 0)[group]]


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which entries of ``x`` are in ``few``."""
    names = ["id", "start", "part", "hash"]
    maybe = np.flatnonzero(np.isin(x["hash"], few["hash"]))
    both = np.concatenate([x[names][maybe], few[names]])
    order = np.lexsort([both[n] for n in names])
    both = both[order]
    group = np.cumsum(np.concatenate(([False], both[1:] != both[:-1])))
    hit = np.isin(group, group[order >= len(maybe)])
    out = np.zeros(len(x), bool)
    out[maybe[order[hit & (order < len(maybe))]]] = True
    return out


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in _ROW.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _spans(x: np.ndarray, width: int, contested: bool = False, bucket: int | None = None) -> list[dict]:
    """A row per document with the byte spans of its entries; touching spans are one unless contested."""
    if not len(x):
        return []
    x = x[np.lexsort((x["start"], x["part"], x["id"]))]
    start, stop = x["start"].astype(np.int64), x["start"].astype(np.int64) + x["n"] + width - 1
    own = np.concatenate(([True], (x["id"][1:] != x["id"][:-1]) | (x["part"][1:] != x["part"][:-1])))
    if not contested:
        group = np.cumsum(own)
        reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40)
        new = own.copy()
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        stop = reach[np.concatenate((at[1:] - 1, [len(x) - 1]))]
        start, own, x = start[at], own[at], x[at]
    cuts = np.flatnonzero(own).tolist()
    return [
        {"bucket": int(x["id"][a]) % 1021 if bucket is None else bucket, "id": int(x["id"][a]), "part": int(x["part"][a]), "contested": contested,
         "starts": start[a:b].astype(np.int32).tobytes(), "stops": stop[a:b].astype(np.int32).tobytes()}
        for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)
    ]


def _dealt(x: np.ndarray, by: str, buckets: int) -> list[dict]:
    if not len(x):
        return []
    # an anchor is a smallest hash, so its own high bits are all alike
    bucket = ((_mix(x[by]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
    return [{"bucket": int(bucket[a]), "entries": _planes(x[a:b])} for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, parts, texts as bytes) of about ``SLICE_BYTES``; a longer text stands alone."""
    for batch in batches:
        columns = [batch.column(n) for n in ("_id", "_part", "_text")]
        start = size = 0
        for i, n in enumerate([*pc.fill_null(pc.binary_length(columns[2]), 0).to_pylist(), SLICE_BYTES + 1]):
            if i > start and size + n > SLICE_BYTES:
                ids, parts, texts = (c.slice(start, i - start).to_pylist() for c in columns)
                yield ids, parts, [(t or "").encode() for t in texts]
                start, size = i, 0
            size += n


def _index(width: int, buckets: int):
    """Texts -> entries dealt by anchor, and the spans that repeat within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = once(("repeats", "hasher"), lambda: Hasher(SLICE_BYTES + 4096))
        pad = 2 * width + SEED
        for ids, parts, texts in _buffers(batches):
            found = []
            if len(texts) == 1:  # perhaps very long: by pieces that overlap, each anchor in one of them
                whole = np.frombuffer(texts[0], np.uint8)
                for lo in range(0, max(1, len(whole)), SLICE_BYTES):
                    a, b = max(0, lo - pad), min(len(whole), lo + SLICE_BYTES + pad)
                    start, n, anchor, h, at = runs(hasher, whole[a:b], np.array([b - a]), width)
                    mine = (at + a >= lo) & (at + a < lo + SLICE_BYTES)
                    found.append((start[mine] + a, n[mine], anchor[mine], h[mine], np.zeros(int(mine.sum()), np.int64)))
            else:
                stops = np.cumsum([len(t) for t in texts])
                start, n, anchor, h, _ = runs(hasher, np.frombuffer(b"".join(texts), np.uint8), stops, width)
                doc = np.searchsorted(stops, start, side="right")
                found.append((start - (stops[doc] - np.diff(np.concatenate(([0], stops)))[doc]), n, anchor, h, doc))
            start, n, anchor, h, doc = (np.concatenate(c) for c in zip(*found, strict=True))
            x = np.empty(len(start), _ENTRY)
            x["anchor"], x["hash"], x["start"], x["n"] = anchor, h, start, n
            x["id"], x["part"] = np.array(ids, np.int64)[doc], np.array(parts, np.int64)[doc]
            kept, repeats = _settle(_order(x))
            yield _rows(_dealt(kept, "anchor", buckets) + _spans(repeats, width))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """Of rows sorted by bucket: (span rows to pass on, rows of a whole bucket)."""
    held: list[dict] = []
    for batch in batches:
        passed = []
        for r in batch.to_pylist():
            if r["entries"] is None:
                passed.append(r)
                continue
            if held and held[0]["bucket"] != r["bucket"]:
                yield passed, held
                passed, held = [], []
            held.append(r)
        yield passed, []
    yield [], held


def _match(width: int):
    """Buckets of entries by anchor -> spans of runs that repeat, and contested runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for passed, rows in _groups(batches):
            out = passed
            if rows:
                family, waiting, size, repeats = Family(), [], 0, []
                for r in rows:
                    waiting.append(_entries(r["entries"]))
                    size += len(waiting[-1])
                    if size >= BATCH:
                        repeats += family.add(np.concatenate(waiting))
                        waiting, size = [], 0
                if waiting:
                    repeats += family.add(np.concatenate(waiting))
                bucket = rows[0]["bucket"]
                out = out + _spans(np.concatenate(repeats), width, bucket=bucket) + _spans(family.contested(), width, True, bucket)
            if out:
                yield _rows(out)

    return run


def _lists(found: list[dict], contested: bool) -> tuple[np.ndarray, np.ndarray]:
    some = [f for f in found or [] if f["contested"] == contested]
    return tuple(np.frombuffer(b"".join(f[n] for f in some), np.int32).astype(np.int64) for n in ("starts", "stops"))


def _windows(width: int, buckets: int):
    """Texts with their contested runs -> the windows of those runs, dealt by hash, and repeats within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = once(("repeats", "hasher"), lambda: Hasher(SLICE_BYTES + 4096))

        def flush(cuts: list[bytes], ids: list, parts: list, starts: list) -> pa.RecordBatch:
            sizes = np.array([len(c) for c in cuts])
            hasher.load(np.frombuffer(b"".join(cuts), np.uint8))
            each = sizes - width + 1
            run_of = np.repeat(np.arange(len(cuts)), each)
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            at = np.repeat(np.cumsum(sizes) - sizes, each) + inside
            x = np.zeros(len(at), _ENTRY)
            x["hash"] = hasher.of(at, at + width)
            x["start"], x["n"] = np.array(starts)[run_of] + inside, 1
            x["id"], x["part"] = np.array(ids, np.int64)[run_of], np.array(parts, np.int64)[run_of]
            kept, repeats = _settle(_order(x))
            return _rows(_dealt(kept, "hash", buckets) + _spans(repeats, width))

        cuts, ids, parts, starts, size = [], [], [], [], 0
        for batch in batches:
            for i, part, text, found in zip(*(batch.column(n) for n in ("_id", "_part", "_text", "_found")), strict=True):
                data = (text.as_py() or "").encode()
                for a, b in zip(*_lists(found.as_py(), True), strict=True):
                    cuts.append(data[a:b])
                    ids.append(i.as_py())
                    parts.append(part.as_py())
                    starts.append(int(a))
                    size += int(b - a)
                    if size > SLICE_BYTES:
                        yield flush(cuts, ids, parts, starts)
                        cuts, ids, parts, starts, size = [], [], [], [], 0
        if cuts:
            yield flush(cuts, ids, parts, starts)

    return run


def _first(width: int):
    """Buckets of windows by hash -> spans of those that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for passed, rows in _groups(batches):
            out = passed
            if rows:
                _, repeats = _settle(_order(np.concatenate([_entries(r["entries"]) for r in rows])))
                out = out + _spans(repeats, width, bucket=rows[0]["bucket"])
            if out:
                yield _rows(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., text, found) -> (.., text, kept bytes, spans removed)."""
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(n)) for n in ("_text", "_found")]
        kept, spans = [], []
        for text, f in zip(*columns, strict=True):
            data = (text.as_py() or "").encode()
            starts, stops = _lists(f.as_py(), False)
            order = np.argsort(starts, kind="stable")
            merged: list[list[int]] = []
            for a, b in zip(starts[order].tolist(), stops[order].tolist(), strict=True):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            ends = [0, *[b for _, b in merged]]
            kept.append(b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in merged], len(data)], strict=True)))
            spans.append([{"start": a, "stop": b} for a, b in merged])
        rest = [i for i, n in enumerate(names) if n not in ("_id", "_part", "_found")]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in rest], pa.array(kept, pa.binary()), pa.array(spans, kind)], names=[*[names[i] for i in rest], "_kept", "_spans"]
        )


def _parts(docs: DataFrame) -> DataFrame:
    """``docs`` (.., _id, _text) with _part: 0, or a number for each different text of an id that has several."""
    digest = docs.select("_id", F.xxhash64("_text").alias("_h")).distinct()
    several = materialise(digest.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if several.isEmpty():
        return docs.withColumn("_part", F.lit(0))
    own = Window.partitionBy("_id").orderBy("_h")
    numbers = digest.join(several, "_id", "left_semi").withColumn("_part", (F.row_number().over(own) - 1).cast("int"))
    joined = docs.withColumn("_h", F.xxhash64("_text")).join(numbers, ["_id", "_h"], "left")
    return joined.withColumn("_part", F.coalesce("_part", F.lit(0))).drop("_h")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, kept: str = "kept", spans: str = "spans") -> DataFrame:
    """``docs`` with the bytes left of each text, and the (start, stop) byte spans removed from it.

    ``id_column`` is a whole number and gives the order of documents, null
    last. A null text is empty; a text shorter than ``width`` bytes keeps all.
    Rows that share an id are not earlier than each other at the same place,
    so that rows given twice keep what one of them would. Columns called
    ``kept`` or ``spans`` are replaced.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c.lower() not in (kept.lower(), spans.lower())]
    names = [f"_c{i}" for i in range(len(rest))]
    names = ["_text" if c == text else n for c, n in zip(rest, names, strict=True)]
    ids = F.coalesce(col(id_column).cast("long"), F.lit(_LAST)).alias("_id")
    source = _parts(docs.select(*[(col(c).cast("string") if c == text else col(c)).alias(n) for c, n in zip(rest, names, strict=True)], ids))
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tasks = spread(spark)
    buckets = max(tasks, size // BUCKET_BYTES + 1)
    texts = source.select("_id", "_part", "_text")

    def settled(rows: DataFrame, match) -> DataFrame:
        return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(match), _ROW)

    def lists(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("id").alias("_id"), F.col("part").alias("_part")).agg(F.collect_list(F.struct("contested", "starts", "stops")).alias("_found"))

    found = materialise(settled(texts.mapInArrow(tidy(_index(width, buckets)), _ROW), _match(width)))
    # whole rows, as in the last join: both then read one shuffle of the texts
    open_runs = source.join(lists(found.filter("contested")), ["_id", "_part"])
    late = settled(open_runs.mapInArrow(tidy(_windows(width, buckets)), _ROW), _first(width))
    all_spans = lists(found.filter("NOT contested").unionByName(late))
    joined = source.join(all_spans, ["_id", "_part"], "left")
    schema = joined.drop("_id", "_part", "_found").schema
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["_kept binary", "_spans array<struct<start:bigint,stop:bigint>>"])
    done = joined.mapInArrow(tidy(_cut), shape)
    return done.select(*[F.col(n).alias(c) for c, n in zip(rest, names, strict=True)], F.col("_kept").alias(kept), F.col("_spans").alias(spans))
