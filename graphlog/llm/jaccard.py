"""An exact join of texts on the Jaccard similarity of their word shingles.

The search is T-occurrence by DivideSkip, laid out for Spark. A text of n
shingles needs T = ceil(similarity * n) of them in any partner. Of its
inverted lists the T - 1 longest are long, the other n - T + 1 short: a partner
must occur on a short list, and only those are merged; the long ones are
probed by binary search for the candidates that remain.

* Lists are told long from short by one fixed order of all shingles: those a
  mergeable summary of the whole corpus names as frequent come last, then by
  hash. Any fixed order is exact; this one keeps frequent lines and passages
  off the merged lists, and the summary bounds the lists that stay.
* Equal sets are one node. Short lists are merged in buckets of a bounded
  number of entries; frequent shingles that a text of little else still needs
  go through an ordinary aggregation and join.
* A list's members are first held against its smallest and largest node, which
  ties dense groups together with few pairs. Lists that still span several
  components are searched in full, by blocks.
* Before a set is fetched for probing, a parity sketch of the pair bounds the
  overlap from above; it discards no pair that reaches the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from graphlog.llm.common import col, pieces, serve, spread, tidy
from graphlog.llm.ties import components
from graphlog.storage import materialise

WINDOW = 1 << 20  # bytes of a long text split into words together
SUMMARY = 1 << 14  # shingles a task's summary of the frequent ones holds
FREQUENT = 1 << 16  # shingles of the merged summary that are moved back
BUCKET = 1 << 21  # entries of short lists merged in one task
SLICE = 2048  # members of a list compared with as many others in one task
HUB = 4096  # sets probed with one set in one task


def _hashes(size: int):
    """A text's hashes of its shingles of ``size`` words, A-Z lowered; one for a shorter text, none without words."""
    import xxhash

    class Memory(dict):
        def __missing__(self, word):
            self[word] = xxhash.xxh64_intdigest(word, 42)
            return self[word]

    known = Memory()
    rnd = np.random.default_rng(20_240_501)
    factors = rnd.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(text: bytes | None) -> np.ndarray:
        data, start, parts = (text or b"").lower(), 0, []
        while start < len(data):
            end = start + WINDOW
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
            words = data[start:end].split()
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            start = end
            if len(known) > 1 << 18:
                known.clear()
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(words):
            return words
        n = max(1, len(words) - size + 1)
        x = np.full(n, min(size, len(words)), np.uint64)
        for k in range(min(size, len(words))):
            x += words[k:k + n] * factors[k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return of


def _summary(size: int, most: int):
    """Batches of texts -> (h, n): a Misra-Gries summary of the task's shingles, counted once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        hashes = _hashes(size)
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge():
            nonlocal names, counts
            new, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            if len(new) > most:  # the new ones are a summary of their own, merged with the one kept
                cut = np.partition(often, len(often) - most - 1)[len(often) - most - 1]
                new, often = new[often > cut], often[often > cut] - cut
            both, which = np.unique(np.concatenate([names, new]), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([counts, often]), minlength=len(both)).astype(np.int64)
            if len(both) > most:
                cut = np.partition(total, len(total) - most - 1)[len(total) - most - 1]
                both, total = both[total > cut], total[total > cut] - cut
            names, counts = both, total

        size_now = 0
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            for text in batch.column(0).to_pylist():
                held.append(np.unique(hashes(text)))
                size_now += len(held[-1])
                if size_now > 1 << 21:
                    merge()
                    size_now = 0
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return run


def _sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the values by their low bits: a power of two of bits, about as many as values."""
    bits = 1 << min(14, max(9, (len(values) - 1).bit_length()))
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(size: int, limit: Fraction, frequent):
    """Batches of (keys.., text) -> (keys.., row, digest, id, n, short, hot, sketch).

    ``short`` are the shingles of the short lists, ``hot`` those of them that
    are frequent. Of equal sets in a task only the first brings its lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        serve("jaccard")
        hashes, often = _hashes(size), frequent.value
        row = TaskContext.get().partitionId() << 40
        seen: set[bytes] = set()
        empty = np.zeros(0, np.int64)
        kind = pa.list_(pa.int64())
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            digests, sizes, short, hot, sketches = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                values = np.unique(hashes(text))
                n = len(values)
                digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                sizes.append(n)
                if n == 0 or digests[-1] in seen:
                    for x in (short, hot, sketches):
                        x.append(None)
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(digests[-1])
                keys = n + limit.numerator * -n // limit.denominator + 1  # n - ceil(limit * n) + 1
                is_hot = often[np.minimum(np.searchsorted(often, values), len(often) - 1)] == values if len(often) else np.zeros(n, bool)
                few = values[~is_hot][:keys]
                short.append(few.view(np.int64))
                hot.append(values[is_hot][:keys - len(few)].view(np.int64) if len(few) < keys else empty)
                sketches.append(_sketch(values))
            ids = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            made = [pa.array(np.arange(row, row + len(sizes))), pa.array(digests, pa.binary()), pa.array(ids), pa.array(sizes, pa.int32()), *[pa.array(x, kind) for x in (short, hot, sketches)]]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_row", "_digest", "_id", "_n", "_short", "_hot", "_sketch"])

    return run


def _blocks(buckets: int):
    """Batches of (id, short) -> (bucket, block): entries (shingle, id) packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate([np.zeros((0, 2), np.int64), *held])
            held.clear()
            at = (entries[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64) if len(entries) else np.zeros(0, np.int64)
            order = np.argsort(at, kind="stable")
            some, first = np.unique(at[order], return_index=True)
            blocks = [x.tobytes() for x in np.split(entries[order], first[1:])] if len(some) else []
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            lists = batch.column(1)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            nodes = np.repeat(batch.column(0).to_numpy(), n)
            held.append(np.stack([lists.flatten().to_numpy(), nodes], axis=1))
            size += len(nodes)
            if size > 1 << 20:
                yield flush()
                size = 0
        yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one bucket -> (kind, a, b): pairs of ids (0), and members of lists of three or more (1)."""
    serve("jaccard")
    held = [np.frombuffer(b, np.int64).reshape(-1, 2) for batch in batches for b in batch.column("block").to_pylist()]
    if not held:
        return
    entries = np.concatenate(held)
    held.clear()
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    entries = entries[np.concatenate(([True], (entries[1:] != entries[:-1]).any(axis=1)))]  # equal sets of several tasks
    first = np.flatnonzero(np.concatenate(([True], entries[1:, 0] != entries[:-1, 0])))
    count = np.diff(np.append(first, len(entries)))
    shared = np.repeat(count > 1, count)
    low, high = np.repeat(entries[first, 1], count)[shared], np.repeat(entries[first + count - 1, 1], count)[shared]
    many = np.repeat(count > 2, count)[shared]
    entries = entries[shared]
    nodes = entries[:, 1]
    pairs = np.concatenate([np.stack([low, nodes], axis=1)[nodes != low], np.stack([nodes, high], axis=1)[(nodes != low) & (nodes != high)]])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    for kind, rows in ((0, pairs), (1, entries[many])):
        for at in range(0, len(rows), 1 << 16):
            part = rows[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["kind", "a", "b"])


def _may_link(limit: Fraction, n: tuple[Column, Column], sketch: tuple[Column, Column]) -> Column:
    """Whether two sets could reach ``limit``, by their sizes and the bits in which their sketches differ."""

    def folded(x: Column, to: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > F.size(to), both).otherwise(x)

    a, b = sketch
    differ = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = (n[0] + n[1]).cast("long")
    near = F.least(*n) * F.lit(limit.denominator).cast("long") >= F.greatest(*n) * F.lit(limit.numerator).cast("long")
    return near & (differ.cast("long") * (limit.numerator + limit.denominator) <= total * (limit.denominator - limit.numerator))


def _pairs_of_lists(limit: Fraction, every: bool):
    """Batches sorted by (list, a, b) -> (list, src, dst): pairs of different components that could reach ``limit``.

    Without ``every``, pairs that a group's earlier ones would connect anyway
    are left out: at most as many as members, the likeliest of each component.
    Members go by size and node, so that lists alike name the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        held: list[tuple] = []
        key = None
        found: list[np.ndarray] = []

        def fold(x: np.ndarray, words: int) -> np.ndarray:
            while x.shape[1] > words:
                x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            return x

        def close() -> None:
            side, node, comp, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
            sketch = [s for x in held for s in x[4]]
            order = np.lexsort((node, n))
            side, node, comp, n = side[order], node[order], comp[order], n[order].astype(np.int64)
            words = np.array([len(sketch[i]) for i in order])
            table = {w: np.stack([sketch[i] for i in order if len(sketch[i]) == w]) for w in np.unique(words).tolist()}
            starts = {w: int(np.searchsorted(words, w)) for w in table}  # sketches grow with n
            top = np.searchsorted(n, n * limit.denominator // limit.numerator, side="right")
            for i in range(len(node)):
                w = int(words[i])
                mine = table[w][i - starts[w]][None, :]
                near, far = [], []
                for v, base in starts.items():
                    s, e = max(i + 1, base), min(int(top[i]), base + len(table[v]))
                    if v < w or s >= e:
                        continue
                    ok = np.flatnonzero((comp[s:e] != comp[i]) & ((side[s:e] == 0) | (side[s:e] != side[i])))
                    if not len(ok):
                        continue
                    differ = np.bitwise_count(fold(table[v][s - base + ok], w) ^ mine).sum(axis=1, dtype=np.int64)
                    may = differ * (limit.numerator + limit.denominator) <= (n[s + ok] + n[i]) * (limit.denominator - limit.numerator)
                    near.append(s + ok[may])
                    far.append(differ[may] / (n[near[-1]] + n[i]))
                if not sum(map(len, near)):
                    continue
                near, far = np.concatenate(near), np.concatenate(far)
                if not every:
                    near = near[np.argsort(far, kind="stable")]
                    met, first = np.unique(comp[near], return_index=True)
                    near = near[first]
                    comp[np.isin(comp, met)] = comp[i]
                found.append(np.stack([np.full(len(near), key[0]), np.minimum(node[near], node[i]), np.maximum(node[near], node[i])], axis=1))

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros((0, 3), np.int64), *found])
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], names=["list", "src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "a", "b")]
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "comp", "n")]
            sketch = batch.column("sketch")
            ends, values = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64)  # counts of bits are of magnitudes
            change = np.zeros(batch.num_rows, bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                here = tuple(int(c[s]) for c in keys)
                if here != key and held:
                    close()
                    held = []
                    if sum(map(len, found)) > 1 << 16:
                        yield flush()
                key = here
                held.append((*[c[s:e] for c in cols], [values[ends[i]:ends[i + 1]] for i in range(s, e)]))
        if held:
            close()
        yield flush()

    return run


def _values(size: int):
    """Batches of texts -> (digest, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        serve("jaccard")
        hashes = _hashes(size)
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            digests, sets = [], []
            for text in batch.column(0).to_pylist():
                values = np.unique(hashes(text))
                digest = xxhash.xxh3_128_digest(values.tobytes())
                if digest not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    sets.append(values.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["_digest", "_set"])

    return run


def _probe(limit: Fraction):
    """Batches sorted by (hub, slice, whether the hub itself comes first) -> verified (src, dst).

    The hub's set is probed by binary search with those of its candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        hub, mine = None, None
        for batch in batches:
            hubs, nodes = batch.column("hub").to_pylist(), batch.column("node").to_pylist()
            sets = batch.column("_set")
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            good = []
            for i, (h, v) in enumerate(zip(hubs, nodes, strict=True)):
                own = values[ends[i]:ends[i + 1]]
                if v == h:
                    hub, mine = h, own.copy()
                    continue
                assert h == hub
                at = np.searchsorted(mine, own)
                overlap = int((mine[np.minimum(at, len(mine) - 1)] == own).sum())
                if overlap * (limit.numerator + limit.denominator) >= limit.numerator * (len(mine) + len(own)):
                    good.append((min(h, v), max(h, v)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, limit: Fraction) -> DataFrame:
    """The (src, dst) of ``pairs`` whose sets reach ``limit``; only the texts of their nodes are read again."""
    both = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    needed = materialise(nodes.select("node", "_digest", "_t").join(both, "node", "left_semi"))
    texts = docs.select(F.col("_text"), F.xxhash64("_text").alias("_t")).join(needed.select("_t").distinct(), "_t", "left_semi").select("_text")
    schema = StructType([StructField("_digest", BinaryType()), StructField("_set", ArrayType(LongType()))])
    made = texts.mapInArrow(tidy(_values(words)), schema)
    sets = materialise(made.join(needed.select("node", "_digest"), "_digest").select("node", "_set").dropDuplicates(["node"]))
    parts = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "src").select(F.col("src").alias("hub"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("slice"), F.col("dst").alias("node"))
    own = parts.select(F.col("src").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), F.col("src").alias("node"))
    rows = dealt.unionByName(own).join(sets, "node").withColumn("later", F.col("hub") != F.col("node"))
    placed = rows.repartition("hub", "slice").sortWithinPartitions("hub", "slice", "later").select("hub", "node", "_set")
    return placed.mapInArrow(tidy(_probe(limit)), "src long, dst long")


def links(made: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, limit: Fraction, near: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes with a link: the components of all pairs that reach ``limit``.

    ``near`` (_t, near) names texts that another method links; each is tested
    with the smallest of its group before lists are searched.

    Lists hold the first 64 bits of a set's digest, so that the lists of equal
    sets need not be sorted out first; an id stands for all nodes that have it.
    """
    spark = nodes.sparkSession
    entries = made.agg(F.sum(F.size("_short"))).first()[0] or 0
    buckets = max(1, -(-entries // BUCKET), min(spread(spark), -(-entries // (1 << 16))))
    packed = made.filter("_short IS NOT NULL").select("_id", "_short").mapInArrow(tidy(_blocks(buckets)), "bucket int, block binary")
    met = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(_merge), "kind int, a long, b long")
    hot = made.select(F.explode("_hot").alias("a"), F.col("_id").alias("b")).distinct()
    ends = hot.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = hot.join(ends, "a")
    stars = held.filter("b <> low").select(F.lit(0).alias("kind"), F.col("low").alias("a"), "b").unionByName(
        held.filter("b <> low AND b <> high").select(F.lit(0).alias("kind"), F.col("b").alias("a"), F.col("high").alias("b")))
    met = materialise(met.unionByName(stars).unionByName(held.filter("n > 2").select(F.lit(1).alias("kind"), "a", "b")))

    sketches = nodes.select(F.col("_id").alias("id"), "node", F.col("_n").alias("n"), F.col("_sketch").alias("sketch"))
    sides = [sketches.select(*[F.col(c).alias(f"{c}_{s}") for c in sketches.columns]) for s in "ab"]
    first = met.filter("kind = 0").select("a", "b").distinct()
    paired = first.join(sides[0], F.col("a") == F.col("id_a")).join(sides[1], F.col("b") == F.col("id_b"))
    likely = paired.filter(_may_link(limit, (F.col("n_a"), F.col("n_b")), (F.col("sketch_a"), F.col("sketch_b"))))
    pairs = likely.select(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst"))
    if near is not None:
        told = materialise(nodes.select("node", "_t").join(near.distinct(), "_t").select("node", "near"))
        lead = told.groupBy("near").agg(F.min("node").alias("src"))
        pairs = pairs.unionByName(told.join(lead, "near").filter("src < node").select("src", F.col("node").alias("dst")))
    tested = materialise(pairs.distinct())
    near = materialise(_verified(tested, nodes, docs, words, limit))
    tied = materialise(components(near))

    def spanning(tied: DataFrame, every: bool, only: DataFrame | None) -> DataFrame:
        """(list, src, dst) of lists that still span components; of lists with the same members one is enough."""
        placed = nodes.select(F.col("_id").alias("b"), "node").join(tied, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        members = met.filter("kind = 1").select(F.col("a").alias("list"), "b")
        members = (members if only is None else members.join(only, "list", "left_semi")).join(placed, "b").select("list", "node", "comp")
        mark = [F.bit_xor(F.xxhash64("node")), F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(F.lit((1 << 40) - 1))), F.min("node"), F.max("node"), F.count(F.lit(1))]
        lists = members.groupBy("list").agg(*[m.alias(f"_m{i}") for i, m in enumerate(mark)], F.min("comp").alias("_c0"), F.max("comp").alias("_c1")).filter("_c0 < _c1")
        lists = lists.groupBy(*[f"_m{i}" for i in range(len(mark))]).agg(F.min("list").alias("list"))
        lists = lists.select("list", F.ceil(F.col("_m4") / F.lit(SLICE)).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        # (a, b): the pair of slices compared; side 0 within one slice, 1 and 2 between two
        tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
            F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
        dealt = members.join(lists, "list").join(sketches.drop("id"), "node").select("list", "node", "comp", "n", "sketch", F.inline(tasks))
        order = ["list", "a", "b"]
        found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(_pairs_of_lists(limit, every)), "list long, src long, dst long")
        return materialise(found)

    # a few pairs a list until they connect nothing more, then all that are left;
    # a list that brought no pair has none
    every, only = False, None
    while True:
        found = spanning(tied, every, only)
        only = found.select("list").distinct()
        more = materialise(found.select("src", "dst").distinct().join(tested, ["src", "dst"], "left_anti"))
        if not more.isEmpty():
            good = materialise(_verified(more, nodes, docs, words, limit))
            tested = tested.unionByName(more)
            if not good.isEmpty():
                near = near.unionByName(good)
                tied = materialise(components(near))
                if not every:
                    continue
        if every or found.isEmpty():
            return tied
        every = True


def frequent(docs: DataFrame, words: int, least: int = 64) -> np.ndarray:
    """Hashes of the shingles that most texts hold, at most ``FREQUENT``, sorted; from mergeable summaries of all texts."""
    found = docs.select("_text").mapInArrow(tidy(_summary(words, SUMMARY)), "h long, n long")
    top = found.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


def groups(docs: DataFrame, keep: list[str], text: str = "text", words: int = 5, similarity: float = 0.8, near: DataFrame | None = None) -> DataFrame:
    """(*keep, n_shingles, root) per row of ``docs``: rows of one root are connected by links.

    Two texts are linked if their sets of shingles (A-Z lowered) share
    ``similarity`` or more of their union; a text of fewer words is one
    shingle. Shingles are compared by 64-bit hashes, sets by 128-bit ones.
    Null, empty and blank texts have no shingles and a null root: what they
    are to each other is the caller's to say. Repeated rows give repeated
    results; an empty table gives none; other columns are not read. ``near``
    (_t, near) may name groups of texts, by their hash, to be tested first.
    """
    limit = Fraction(str(similarity))
    if not 0 < limit <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    spark = docs.sparkSession
    names = [f"_k{i}" for i in range(len(keep))]
    slim = docs.select(*[col(c).alias(n) for c, n in zip(keep, names, strict=True)], col(text).cast("binary").alias("_text"))
    often = spark.sparkContext.broadcast(frequent(slim, words))
    source = slim.select(*names, F.xxhash64("_text").alias("_t"), "_text")
    arrays = [StructField(c, ArrayType(LongType())) for c in ("_short", "_hot", "_sketch")]
    schema = StructType([*source.drop("_text").schema, StructField("_row", LongType()), StructField("_digest", BinaryType()),
                         StructField("_id", LongType()), StructField("_n", IntegerType()), *arrays])
    made = materialise(source.mapInArrow(tidy(_sets(words, limit, often)), schema))
    lead = made.filter("_short IS NOT NULL").groupBy("_digest")
    nodes = materialise(lead.agg(F.min("_row").alias("node"), *[F.first(c).alias(c) for c in ("_id", "_t", "_n", "_sketch")]))
    tied = links(made, nodes, slim, words, limit, near)
    roots = nodes.join(tied, "node", "left").select("_digest", F.coalesce("component", "node").alias("root"))
    rows = made.select(*names, "_digest", "_n").join(roots, "_digest", "left")
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_n").cast("long").alias("n_shingles"), "root")


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``: the smallest id its text is connected with by links.

    As ``groups``; a text without shingles is connected with itself alone. Null
    ids are passed over by the minimum (null only if a component has no other).
    """
    rows = materialise(groups(docs, [id_column], text, words, similarity))
    low = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(col(id_column)).alias("component_id"))
    alone = rows.filter("root IS NULL").select(col(id_column), "n_shingles", col(id_column).alias("component_id"))
    return rows.join(low, "root").select(col(id_column), "n_shingles", "component_id").unionByName(alone)


#: The same classes in DuckDB: all pairs that share a shingle, and whom each text reaches.
SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
    s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh FROM (SELECT rid, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    p AS (SELECT a.rid AS u, b.rid AS v, count(*) AS met FROM s a JOIN s b USING (sh) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
    e AS (SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * met >= 80 * (x.n + y.n - met)),
    r AS (SELECT rid, rid AS root FROM w UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.rid)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
    FROM w JOIN r ON r.rid = w.rid JOIN w o ON o.rid = r.root LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id"""
