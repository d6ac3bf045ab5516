"""Near duplicates by SimHash: fingerprints, linked blocks, components.

A fingerprint of 64 bits is the majority vote of the XXH64 values of a text's
word shingles. Fingerprints that differ in at most ``distance`` bits are
linked. By the pigeonhole principle two of them agree in at least ``parts -
distance`` of ``parts`` equal blocks, so each choice of that many blocks gives
one join key and every linked pair meets under at least one of them.

Equal fingerprints are one row from the start. Members of a bucket are
compared inside a task and only the links of each member to the smallest of
its component go on, never all pairs; a bucket above ``bucket_rows`` is dealt out as pairs of
slices, each its own task, so that it is searched whole with bounded memory.

``deduplicate`` takes what the fingerprints link, checks it exactly, and adds by
``jaccard`` the near copies that fingerprints of 64 bits miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlog.llm import jaccard
from graphlog.llm.common import col, free_name, pieces, serve, spread, tidy
from graphlog.llm.ties import components
from graphlog.storage import materialise

BUCKET_ROWS = 4096
BITS = 64


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones = np.unpackbits(np.ascontiguousarray(h[at:at + (1 << 15)]).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        full = len(ones) // 255 * 255  # 255 rows of bytes 0 or 1 add up without a carry
        if full:
            total += ones[:full].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        if full < len(ones):
            total += ones[full:].sum(axis=0).view(np.uint8).astype(np.int64)
    return total


def _shingles(size: int, fold: bool):
    """A text's hashes of its shingles of ``size`` words, one for a shorter text, none without words."""
    import re

    import xxhash

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    digest = xxhash.xxh64_intdigest

    def of(text: str | None) -> np.ndarray:
        data = (text or "").encode()
        words = word.findall(data.lower() if fold else data)
        if not words:
            return np.zeros(0, np.uint64)
        n = max(1, len(words) - size + 1)
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)

    return of


def _prints(size: int, fold: bool):
    """Arrow batches of (keys.., text) -> (keys.., fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _shingles(size, fold)

        def of(text: str | None) -> bytes:
            h = hashes(text)
            return np.packbits(_votes(h) * 2 > len(h), bitorder="little").tobytes() if len(h) else bytes(8)

        serve("simhash")
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            made = b"".join(of(t) for t in batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.frombuffer(made, np.int64))], names=[*batch.schema.names[:-1], "_print"])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", out: str = "fingerprint", words: int = 3, fold: bool = True) -> DataFrame:
    """The columns ``keep`` and a long fingerprint of ``text``, a row per row.

    ``fold`` lower-cases A-Z. A text of fewer than ``words`` words is one
    shingle; one without words, an empty and a null text have fingerprint 0.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[col(c).alias(n) for c, n in zip(keep, names, strict=True)], col(text).cast("string").alias("_text"))
    made = source.mapInArrow(tidy(_prints(words, fold)), source.drop("_text").schema.add("_print", "long"))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_print").alias(out))


def _edges(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each block, lowest first."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _stars(nodes: np.ndarray, prints: np.ndarray, cut: int | None, distance: int) -> np.ndarray:
    """(smallest node, node) for each component of the pairs of rows, or of pairs across ``cut``.

    At most rows - 1 links, and the same ones from every bucket that holds the
    same group, so that a large group does not multiply them.
    """
    tree = np.arange(len(nodes))
    for i in range(len(nodes) if cut is None else cut):
        first = i + 1 if cut is None else cut
        near = tree[first:][np.bitwise_count(prints[first:] ^ prints[i]).sum(axis=1) <= distance]
        near = np.unique(near[near != tree[i]])
        if len(near):
            tree[np.isin(tree, near)] = tree[i]
    return _ties(nodes, tree)


def _ties(nodes: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """(smallest node, node) of each tree."""
    order = np.lexsort((nodes, tree))
    nodes, tree = nodes[order], tree[order]
    new = np.concatenate(([True], tree[1:] != tree[:-1]))
    low = nodes[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return np.stack([low, nodes], axis=1)[nodes != low]


def _scan(group: list[str], distance: int):
    """Batches sorted by ``group``: the links of each group, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key = None
        links: list[np.ndarray] = []
        count = 0

        def close() -> None:
            nonlocal count
            side, nodes, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(nodes) > 1:
                order = np.argsort(side, kind="stable")
                cut = int((side == 1).sum()) if side.any() else None
                links.append(_stars(nodes[order], prints[order], cut, distance))
                count += len(links[-1])

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *links])
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in group]
            side, nodes = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_side", "_node"))
            prints = nodes.view(np.uint64).reshape(-1, 1)
            change = np.zeros(len(nodes), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(nodes)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                here = tuple(int(c[s]) for c in cols)
                if here != key and held:
                    close()
                    held = []
                key = here
                held.append((side[s:e], nodes[s:e], prints[s:e]))
            if count > 1 << 16 or len(links) > 1 << 16:
                yield flush()
                count = 0
        if held:
            close()
        yield flush()

    return run


def _linked(members: DataFrame, group: list[str], distance: int, rows: int) -> DataFrame:
    """(src, dst) links between the members (*group, _node) of each group."""
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    slices = F.ceil(F.col("_n") / F.lit(rows)).cast("int")
    own = F.pmod(F.xxhash64("_node"), slices).cast("int")
    # (a, b): the pair of slices compared; side 0 within one slice, 1 and 2 between two
    tasks = F.transform(
        F.sequence(F.lit(0), slices - 1),
        lambda o: F.struct(
            F.least(own, o).alias("_a"), F.greatest(own, o).alias("_b"),
            F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("_side"),
        ),
    )
    dealt = members.join(sizes, group).select("_node", *group, F.inline(tasks))
    keys = [*group, "_a", "_b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_scan(keys, distance)), "src long, dst long").distinct()


def links(prints: DataFrame, column: str = "fingerprint", distance: int = 3, parts: int = 6, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(src, dst): links whose components are those of all pairs within ``distance`` bits.

    A key is made of ``parts - distance`` of ``parts`` blocks. ``prints`` may
    repeat a fingerprint; nulls take no part.
    """
    agree = parts - distance
    if not 0 < agree <= parts <= BITS:
        raise ValueError("need distance below parts and at most 64 parts")
    one = prints.select(col(column).alias("_node")).filter("_node IS NOT NULL").distinct()
    one = one.repartition(spread(prints.sparkSession), "_node")  # few bytes now, many rows next
    blocks = _edges(parts)
    keys = []
    for chosen in combinations(range(parts), agree):
        mask = sum(((1 << blocks[i][1]) - 1) << blocks[i][0] for i in chosen)
        keys.append(F.col("_node").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    keyed = one.select("_node", F.posexplode(F.array(*keys)).alias("_set", "_key"))
    return _linked(keyed, ["_set", "_key"], distance, bucket_rows)


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3,
           parts: int = 6, keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, fingerprint, root, component_id) per row of ``docs``.

    ``root`` is a fingerprint that names the component, ``component_id`` the
    smallest id in it. Null ids are passed over by that minimum (null only if
    the whole component has none). Repeated rows give repeated results; no
    words at all is fingerprint 0, linked like any other; an empty table gives
    no rows.
    """
    keep = [c for c in (keep or []) if c != id_column]
    prints = materialise(fingerprints(docs, [id_column, *keep], text, "_fp", words))
    tied = components(links(prints, "_fp", distance, parts)).withColumnsRenamed({"node": "_fp", "component": "_root"})
    lowest = prints.groupBy("_fp").agg(F.min(col(id_column)).alias("_low"))
    named = lowest.join(tied, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    lead = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    labels = named.join(lead, "_root").select("_fp", F.col("_root").alias("root"), "component_id")
    rows = prints.join(labels, "_fp")
    return rows.select(col(id_column), *[col(c) for c in keep], F.col("_fp").alias("fingerprint"), "root", "component_id")


def hexed(fingerprint) -> F.Column:
    """Sixteen lower-case hex digits of a long."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
                distance: int | None = None) -> DataFrame:
    """One row of each group of near copies: that of the smallest id (nulls last), then of the smallest text hash.

    Near copies share ``similarity`` or more of their shingles of ``words``
    words; groups are the components of all such pairs. With ``distance``, the
    texts whose fingerprints are linked (as in ``groups``) are checked for that
    first, and an exact join adds the pairs that 64 bits miss. Null, empty
    and blank texts are one group. Columns stay as they are. The texts meet
    only the keys of the rows that stay; rows that repeat an id and a text are
    set apart by a count, so that few texts are compared for that.
    """
    names = ["_nid", "_sid", "_txt"]
    key = [free_name(docs, n) for n in names]
    value = [col(id_column).isNull(), F.coalesce(col(id_column).cast("string"), F.lit("")), F.xxhash64(col(text))]
    slim = docs.select(*[v.alias(n) for v, n in zip([col(id_column), *value], ["_id", *names], strict=True)], col(text).alias("_said"))
    near = None
    if distance is not None:
        texts = slim.select("_said", F.xxhash64(F.col("_said").cast("binary")).alias("_t"))
        near = groups(texts, "_t", "_said", distance=distance).select("_t", F.col("root").alias("near"))
    labels = jaccard.groups(slim, ["_id", *names], "_said", words, similarity, near)
    each = labels.groupBy(F.coalesce("root", F.lit(-1)).alias("root"), "_id", *names).agg(F.count(F.lit(1)).alias("_times"))
    order = F.struct("_nid", "_id", "_txt", "_sid", "_times")
    first = each.groupBy("root").agg(F.min(order).alias("_m"))
    chosen = materialise(first.select(*[F.col(f"_m.{n}").alias(k) for n, k in zip(names, key, strict=True)], F.col("_m._times").alias("_times")))
    marked = docs.withColumns(dict(zip(key, value, strict=True)))
    once = marked.join(chosen.filter("_times = 1").drop("_times"), key, "left_semi")
    repeated = marked.join(chosen.filter("_times > 1").drop("_times"), key, "left_semi").dropDuplicates(key)
    return once.unionByName(repeated).select(*[col(c) for c in docs.columns])
