"""Traversals as equi-joins: neighbourhoods, typed patterns, shortest paths.

Every join carries ``model_id``, so no walk leaves its tenant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.storage import distinct_rows, materialise

MAX_HOPS = 10


def within_tenant(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends both are nodes of the edge's tenant."""
    keys = nodes.select("model_id", "node")
    for side in ("src", "dst"):
        edges = edges.join(keys.withColumnRenamed("node", side), ["model_id", side], "left_semi")
    return edges


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(model_id, a, b): one step from a to b along, against or both ways."""
    out = edges.select("model_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select("model_id", F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction != "both":
        raise ValueError(f"unknown direction: {direction}")
    return out.unionByName(back)


def reach(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "out", step: DataFrame | None = None) -> DataFrame:
    """(model_id, root, node) reached by walks of exactly ``hops`` steps.

    Ends are made distinct at each hop, so the frontier never holds one row
    per walk; each hop is written, so its rows are dealt by their number. ``step`` may give the steps as ``stored_steps`` keeps them.
    """
    step = steps(edges, direction) if step is None else step
    front = roots.select("model_id", F.col("node").alias("root"), F.col("node").alias("a")).distinct()
    for _ in range(hops):
        front = distinct_rows(front.join(step, ["model_id", "a"]).select("model_id", "root", F.col("b").alias("a")))
    return front.select("model_id", "root", F.col("a").alias("node"))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 1, most: int = 3, step: DataFrame | None = None) -> DataFrame:
    """Distinct nodes within ``depth`` undirected steps, the root left out.

    A depth beyond 0..``most`` is an error. Levels are written, so each is
    worked out once. ``step`` may give both ways' steps as ``stored_steps``
    keeps them.
    """
    if not 0 <= depth <= most:
        raise ValueError(f"{depth} is not within 0..{most}")
    if step is None:
        step = materialise(distinct_rows(steps(edges))) if depth > 1 else steps(edges)
    front = roots.select("model_id", F.col("node").alias("root"), F.col("node").alias("a")).distinct()
    seen = front
    for hop in range(depth):
        front = front.join(step, ["model_id", "a"]).select("model_id", "root", F.col("b").alias("a"))
        front = materialise(distinct_rows(front)) if hop + 1 < depth else front
        seen = seen.unionByName(front)
    found = distinct_rows(seen.filter(F.col("a") != F.col("root")))
    return found.select("model_id", "root", F.col("a").alias("node"))


@dataclass(frozen=True)
class Hop:
    """One edge of a pattern: its label and direction (out, in or both)."""

    label: str | None = None
    direction: str = "out"


@dataclass(frozen=True)
class Spot:
    """One node of a pattern: its type and a test on its columns."""

    type: str | None = None
    where: Callable[[DataFrame], Column] | None = None


def match(nodes: DataFrame, edges: DataFrame, pattern: list[Spot | Hop]) -> DataFrame:
    """Fixed-length typed paths: columns ``n0``, ``n1``, ... per node spot.

    Each spot is filtered before its join, and an edge's far end meets its
    spot before the edge meets the paths, so that a node of many neighbours of
    other types does not multiply them. No edge is used twice in one path.
    """
    def spot(s: Spot, i: int) -> DataFrame:
        rows = nodes
        if s.type is not None:
            rows = rows.filter(F.col("type") == s.type)
        if s.where is not None:
            rows = rows.filter(s.where(rows))
        return rows.select("model_id", F.col("node").alias(f"n{i}"))

    def hop(h: Hop, i: int) -> DataFrame:
        rows = edges if h.label is None else edges.filter(F.col("label") == h.label)
        key = F.struct("label", "src", "dst", *(["edge"] if "edge" in edges.columns else []))
        out = rows.select("model_id", F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), key.alias(f"e{i}"))
        back = rows.select("model_id", F.col("dst").alias(f"n{i}"), F.col("src").alias(f"n{i + 1}"), key.alias(f"e{i}"))
        return {"out": out, "in": back}.get(h.direction) if h.direction != "both" else out.unionByName(back)

    paths = spot(pattern[0], 0)
    for i, (h, s) in enumerate(zip(pattern[1::2], pattern[2::2])):
        far = hop(h, i).join(spot(s, i + 1), ["model_id", f"n{i + 1}"])
        paths = paths.join(far, ["model_id", f"n{i}"])
        for earlier in range(i):
            paths = paths.filter(F.col(f"e{earlier}") != F.col(f"e{i}"))
    return paths.select("model_id", *[f"n{i}" for i in range(len(pattern) // 2 + 1)])


def _numbered(ends: DataFrame, side: str) -> DataFrame:
    """(model_id, ``side``, block, bit): distinct ends, up to 64 of them to a block."""
    ordered = ends.distinct().repartitionByRange("model_id", side).sortWithinPartitions("model_id", side)
    held = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return held.select("model_id", side, F.expr("shiftright(_at, 6)").alias("block"), F.expr("shiftleft(1L, CAST(_at % 64 AS INT))").alias("bit"))


def _common(bits: DataFrame, mask: DataFrame, key: list[str]) -> DataFrame:
    """Per ``key``: the bits of all its rows that the mask has; keys without one are left out."""
    none = F.lit(0).cast("long")
    rows = bits.select(*key, "bits", none.alias("mask")).unionByName(mask.select(*key, none.alias("bits"), "mask"))
    kept = rows.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bit_or("mask").alias("mask"))
    return kept.select(*key, F.col("bits").bitwiseAND(F.col("mask")).alias("bits")).filter("bits <> 0")


def _next_level(front: DataFrame, last: DataFrame, step: DataFrame, mask: DataFrame) -> DataFrame:
    """New nodes one step on, each with the ends of a block that reach it, as bits.

    A step from hop k can only meet hops k-1, k and k+1, so new nodes are
    told by the last two levels. ``mask`` has the ends still searched from.
    """
    key = ["model_id", "block", "node"]
    known = front.unionByName(last)
    front = front.join(mask, ["model_id", "block"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("mask"))).filter("bits <> 0")
    ahead = front.select("model_id", "block", F.col("node").alias("a"), "bits").join(step, ["model_id", "a"])
    none = F.lit(0).cast("long")
    rows = ahead.select("model_id", "block", F.col("b").alias("node"), "bits", none.alias("known"))
    rows = rows.unionByName(known.select(*key, none.alias("bits"), F.col("bits").alias("known")))
    fresh = rows.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
    return fresh.select(*key, F.col("bits").bitwiseAND(F.bitwise_not("known")).alias("bits")).filter("bits <> 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS, most: int = MAX_HOPS) -> DataFrame:
    """Per (model_id, src, dst) pair: the nodes of a shortest undirected path.

    Breadth-first from both ends, the smaller frontier first, one search per
    64 distinct sources and one per 64 distinct targets serving all their
    pairs: a level has a node once, with a bit for each end that reached it.
    A pair is settled when its frontiers meet; an end with no open pair stops.
    Levels are written out, so each hop starts from files. Nodes with one
    neighbour cannot lie inside a path and are left out unless asked for. Of
    equally short paths, the one with the smallest predecessors, walking back
    from the target, is given. Pairs without a path within ``max_hops`` are
    absent.
    """
    if not 1 <= max_hops <= most:
        raise ValueError(f"{max_hops} is not within 1..{most}")
    pair = ["model_id", "src", "dst"]
    asked = materialise(pairs.select(*pair).filter(F.col("src") != F.col("dst")).distinct())
    once = edges.filter(F.col("src") != F.col("dst")).select("model_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    every = steps(materialise(distinct_rows(once)))
    inner = every.groupBy("model_id", F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    ends = asked.select("model_id", F.col("src").alias("b")).unionByName(asked.select("model_id", F.col("dst").alias("b")))
    useful = inner.select("model_id", "b").unionByName(ends).distinct()
    step = materialise(every.join(useful, ["model_id", "b"], "left_semi"))

    number = {side: _numbered(asked.select("model_id", side), side) for side in ("src", "dst")}
    for side, named in number.items():
        asked = asked.join(named.withColumnsRenamed({"block": f"{side}_block", "bit": f"{side}_bit"}), ["model_id", side])
    open_pairs = asked = materialise(asked)
    levels: dict[str, list[DataFrame]] = {}
    size: dict[str, int] = {}
    for side, named in number.items():
        levels[side] = [named.select("model_id", "block", F.col(side).alias("node"), F.col("bit").alias("bits"))]
        size[side] = named.count()

    def searched(side: str) -> DataFrame:
        return open_pairs.groupBy("model_id", F.col(f"{side}_block").alias("block")).agg(F.bit_or(f"{side}_bit").alias("mask"))

    settled = []
    while len(levels["src"]) + len(levels["dst"]) - 2 < max_hops:
        side = "src" if size["src"] <= size["dst"] else "dst"
        own = levels[side]
        own.append(materialise(_next_level(own[-1], own[-2] if len(own) > 1 else own[-1], step, searched(side))))
        size[side] = own[-1].count()
        i, j = len(levels["src"]) - 1, len(levels["dst"]) - 1
        # the sources that meet each target, whatever the number of nodes they meet at
        near = levels["src"][-1].withColumnsRenamed({"block": "src_block", "bits": "src_bits"})
        targets = open_pairs.select("model_id", "dst", F.col("dst_block").alias("block"), F.col("dst_bit").alias("bit")).distinct()
        far = levels["dst"][-1].join(targets, ["model_id", "block"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        met = near.join(far.select("model_id", "node", "dst"), ["model_id", "node"])
        met = met.groupBy("model_id", "dst", "src_block").agg(F.bit_or("src_bits").alias("src_bits"))
        hit = open_pairs.join(met, ["model_id", "dst", "src_block"]).filter(F.col("src_bits").bitwiseAND(F.col("src_bit")) != 0)
        hit = materialise(hit.select(*asked.columns, F.lit(i).alias("i"), F.lit(j).alias("j")))
        settled.append(hit)
        open_pairs = materialise(open_pairs.join(hit, pair, "left_anti"))
        if size[side] == 0 or open_pairs.isEmpty():
            break
    return _walk_back(step, levels, settled)


def _walk_back(step: DataFrame, levels: dict[str, list[DataFrame]], settled: list[DataFrame]) -> DataFrame:
    """Paths of the pairs that met, ``i`` steps from the source and ``j`` from the target.

    From the nodes where a source's pairs met, the search goes on towards
    their targets through the nodes the backward search has seen at the right
    distance. That depends on the source and the hop it met at, not on the
    target, so pairs share it. Then each path is walked back from its target:
    of a node's neighbours that the source reached one step earlier, the
    smallest is the predecessor.
    """
    pair = ["model_id", "src", "dst"]
    shared = ["model_id", "i", "block", "node"]
    pairs = settled[0]
    for more in settled[1:]:
        pairs = pairs.unionByName(more)
    pairs = materialise(pairs)
    depth_i, depth_j = len(levels["src"]) - 1, len(levels["dst"]) - 1
    wants = materialise(
        pairs.groupBy("model_id", "dst_block", "dst_bit", "i", "j", "src_block").agg(F.bit_or("src_bit").alias("mask"))
    )

    def wanted(hop: int) -> DataFrame:
        """Nodes ``hop`` steps past a meeting, by the sources of the pairs that go there."""
        out = None
        for j in range(hop, depth_j + 1):
            near = levels["dst"][j - hop].withColumnRenamed("block", "dst_block")
            part = near.join(wants.filter(F.col("j") == j), ["model_id", "dst_block"]).filter(F.col("bits").bitwiseAND(F.col("dst_bit")) != 0)
            part = part.select("model_id", "i", F.col("src_block").alias("block"), "node", "mask")
            out = part if out is None else out.unionByName(part)
        return out

    start = None
    for i in range(depth_i + 1):
        level = levels["src"][i].withColumn("i", F.lit(i))
        start = level if start is None else start.unionByName(level)
    past = [materialise(_common(start, wanted(0), shared))]
    for hop in range(1, depth_j + 1):
        ahead = past[-1].withColumnRenamed("node", "a").join(step, ["model_id", "a"]).withColumnRenamed("b", "node")
        past.append(materialise(_common(ahead, wanted(hop), shared)))

    def back(trail: DataFrame, before: DataFrame, on: Column, key: list[str]) -> DataFrame:
        """Put the smallest neighbour that is in the level before ahead of each path's first node."""
        moved = trail.filter(on)
        here = moved.select(*key, "src_bit", "node").distinct()
        near = here.join(step.withColumnRenamed("a", "node"), ["model_id", "node"])
        near = near.join(before.withColumnRenamed("node", "b"), [*key, "b"]).filter(F.col("bits").bitwiseAND(F.col("src_bit")) != 0)
        found = near.groupBy(*key, "src_bit", "node").agg(F.min("b").alias("parent"))
        moved = moved.join(found, [*key, "src_bit", "node"])
        moved = moved.withColumn("path", F.concat(F.array("parent"), F.col("path"))).withColumn("node", F.col("parent"))
        return materialise(moved.select(*trail.columns).unionByName(trail.filter(~on)))

    trail = pairs.select(*pair, F.col("src_block").alias("block"), "src_bit", "i", "j", F.col("dst").alias("node"), F.array("dst").alias("path"))
    for hop in range(depth_j, 0, -1):
        trail = back(trail, past[hop - 1], F.col("j") >= hop, ["model_id", "i", "block"])
    for hop in range(depth_i, 0, -1):
        trail = back(trail, levels["src"][hop - 1], F.col("i") >= hop, ["model_id", "block"])
    return trail.select(*pair, (F.col("i") + F.col("j")).alias("length"), "path")
