"""Sharding by a weighted hash tree of regions, racks and shards.

A row goes down the tree. At each level every child draws -ln(u) / weight from
a hash of the row's key and the child's path, and the smallest draw wins, so a
child receives its weight's share and, when weights change, rows move only
towards subtrees that gained weight. A shard's place is a pure function of the
key and the tree: no state, no shuffle to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.llm.common import col, free_name, uniform
from graphlog.operators.runs import numbered

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Equal shards 0..n-1 in regions of ``racks`` racks of ``per_rack`` shards, filled in order.

    A shard that starts a new region changes the weights of no other subtree,
    so that all rows that move, move to it.
    """
    out: Tree = {}
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        out.setdefault(f"r{region}", {}).setdefault(f"k{rest // per_rack}", {})[s] = 1.0
    return out


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _levels(layout: Tree) -> tuple[list[dict[str, list[tuple[str, float]]]], dict[str, int]]:
    """Per level: path -> (child's path, its weight); and the shard of each leaf's path."""
    levels: list[dict[str, list[tuple[str, float]]]] = []
    leaves: dict[str, int] = {}
    below: dict[str, object] = {"": layout}
    while below:
        here, deeper = {}, {}
        for path, node in below.items():
            here[path] = [(f"{path}/{name}", _weight(child)) for name, child in node.items() if _weight(child) > 0]
            for name, child in node.items():
                if isinstance(child, dict):
                    deeper[f"{path}/{name}"] = child
                else:
                    leaves[f"{path}/{name}"] = int(name)
        levels.append(here)
        below = deeper
    return levels, leaves


def assign(key: Column, layout: Tree) -> Column:
    """The shard of a key; null only if nothing in the tree has weight.

    A null key is a key like any other; weights at or below zero take nothing.
    """
    levels, leaves = _levels(layout)
    key = F.coalesce(key.cast("string"), F.lit(""))
    at = F.lit("")
    for level in levels:
        children = F.create_map(*[
            x for path, below in level.items() if below
            for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in below]))
        ]) if any(level.values()) else None
        if children is None:
            return F.lit(None).cast("int")
        draws = F.transform(
            F.try_element_at(children, at),
            lambda c: F.struct((-F.log(uniform(key, c.getField("path"))) / c.getField("weight")).alias("draw"), c.getField("path").alias("path")),
        )
        at = F.array_min(draws).getField("path")
    return F.try_element_at(F.create_map(*[x for p, s in leaves.items() for x in (F.lit(p), F.lit(s))]), at)


def place(rows: DataFrame, key: str, layout: Tree, grown: Tree | None = None, order: list[str] | None = None,
          shard: str = "shard", slot: str = "slot", grown_shard: str = "grown_shard") -> DataFrame:
    """``rows`` with a shard, a gapless slot from 0 in it, and the shard in a ``grown`` tree.

    Slots follow ``order`` (the key unless given; ties in any order) and come from a range partition with
    counts before each range, so that no shard is numbered by one task. Give
    this narrow rows: they are sorted and written once.
    """
    inner = {n: free_name(rows, n) for n in ("_shard", "_grown", "_slot")}
    marked = rows.withColumns({inner["_shard"]: assign(col(key), layout), inner["_grown"]: assign(col(key), grown) if grown else F.lit(None).cast("int")})
    done = numbered(marked, inner["_shard"], order or [key], inner["_slot"])
    taken = {shard.lower(), slot.lower(), grown_shard.lower()}
    return done.select(
        *[col(c) for c in rows.columns if c.lower() not in taken],
        col(inner["_shard"]).alias(shard), (col(inner["_slot"]) - 1).alias(slot), col(inner["_grown"]).alias(grown_shard),
    )


def placement_sql(shards: int, rows: str) -> str:
    """SQL over ``rows`` (rid, key) for (rid, shard): the same draws, level by level."""
    levels, leaves = _levels(tree(shards))
    before = f"SELECT rid, key, '' AS at FROM {rows}"
    for level in levels:
        nodes = ", ".join(f"('{parent}', '{path}', {weight})" for parent, below in level.items() for path, weight in below)
        draw = "-ln((('0x' || substr(md5(key || '/' || n.path), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / n.weight"
        before = f"SELECT rid, key, min_by(n.path, {draw}) AS at FROM ({before}) b JOIN (VALUES {nodes}) n(parent, path, weight) ON n.parent = b.at GROUP BY rid, key"
    ends = ", ".join(f"('{path}', {shard})" for path, shard in leaves.items())
    return f"SELECT rid, shard FROM ({before}) b JOIN (VALUES {ends}) s(path, shard) ON s.path = b.at"


SQL = f"""WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
m AS (SELECT rid, doc_id, (length(h) // 2 + 1)::BIGINT AS size, CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) END AS text_crc32
    FROM d, crc),
now AS ({placement_sql(16, "d")}),
grown AS ({placement_sql(17, "d")})
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard::INT AS shard,
    row_number() OVER (PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown.shard::INT AS grown_shard
FROM m JOIN now USING (rid) JOIN grown USING (rid)"""
