"""Scans, lookups, keyset pages, counts and log listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.functions.literals import unquote


def bounded(value: int | None, default: int, most: int) -> int:
    """``value``, or ``default`` if there is none; beyond 1..``most`` is an error, never a shorter answer."""
    value = default if value is None else value
    if not 1 <= value <= most:
        raise ValueError(f"{value} is not within 1..{most}")
    return value


def typed_scan(nodes: DataFrame, model_id: str, node_type: str, include_tombstoned: bool = True) -> DataFrame:
    rows = nodes.filter((F.col("model_id") == model_id) & (F.col("type") == node_type))
    return rows if include_tombstoned else rows.filter(~F.col("tombstoned"))


def lookup(nodes: DataFrame, model_id: str, node: str) -> DataFrame:
    return nodes.filter((F.col("model_id") == model_id) & (F.col("node") == node))


def lookup_many(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes named by a table of (model_id, node)."""
    return nodes.join(keys.select("model_id", "node"), ["model_id", "node"], "left_semi")


def page(nodes: DataFrame, model_id: str, node_type: str, after: int = 0, limit: int | None = None,
         where: Column | None = None, most: int = 500) -> DataFrame:
    """The next page by sequence number: default 50 rows, at most ``most``.

    One row past the page decides ``next_after``: the last number of the page
    when more rows follow, else null.
    """
    size = bounded(limit, 50, most)
    return cut(typed_scan(nodes, model_id, node_type), after, size, where)


def cut(rows: DataFrame, after: int, size: int, where: Column | None) -> DataFrame:
    """The first ``size`` rows past ``after`` that fit, with ``next_after``."""
    rows = rows.filter(F.col("seq") > after)
    if where is not None:
        rows = rows.filter(where)
    fetched = rows.orderBy("seq").limit(size + 1)
    numbered = fetched.withColumn("_all", F.lit(1))
    # at most size + 1 rows reach this window
    w = Window.partitionBy("_all").orderBy("seq")
    ranked = numbered.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_all")))
    ranked = ranked.withColumn("_last", F.max(F.when(F.col("_at") <= size, F.col("seq"))).over(Window.partitionBy("_all")))
    more = F.when(F.col("_n") > size, F.col("_last"))
    return ranked.filter(F.col("_at") <= size).withColumn("next_after", more).drop("_all", "_at", "_n", "_last")


def filtered_page(nodes: DataFrame, model_id: str, node_type: str, equal: dict[str, str], after: int = 0,
                  limit: int | None = None, most: int = 100) -> DataFrame:
    """A page of nodes whose properties equal the given texts: 20 rows, at most ``most``.

    The filter runs before the page is cut; a missing property never matches.
    """
    return cut(typed_scan(nodes, model_id, node_type), after, bounded(limit, 20, most), matching(equal))


def matching(equal: dict[str, str]) -> Column:
    """Whether a node's properties equal the given texts."""
    where = F.lit(True)
    for name, text in equal.items():
        where = where & (unquote(F.col("props")[name]) == text)
    return where


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("model_id", "type").agg(F.count(F.lit(1)).alias("n"))


def count_by_label(edges: DataFrame) -> DataFrame:
    return edges.groupBy("model_id", "label").agg(F.count(F.lit(1)).alias("n"))


def first_by(nodes: DataFrame, order: list[Column], n: int) -> DataFrame:
    return nodes.orderBy(*order).limit(n)


def newest(log: DataFrame, time: str, tie: str, limit: int | None = None, top: int = 500,
           where: Column | None = None, before: tuple | None = None) -> DataFrame:
    """Newest-first listing of a log: default 100 rows, at most ``top``.

    ``before`` is the (time, tie) of the last row of the page before.
    """
    rows = log if where is None else log.filter(where)
    if before is not None:
        rows = rows.filter((F.col(time) < F.lit(before[0])) | ((F.col(time) == F.lit(before[0])) & (F.col(tie) < F.lit(before[1]))))
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(bounded(limit, 100, top))


def audit_listing(calls: DataFrame, model_id: str, agent: str | None = None, start: Column | None = None,
                  end: Column | None = None, limit: int | None = None, before: tuple | None = None) -> DataFrame:
    """Newest agent calls of a tenant, by agent and time span."""
    where = F.col("model_id") == model_id
    if agent is not None:
        where = where & (F.col("agent_id") == agent)
    if start is not None:
        where = where & (F.col("called_at") >= start)
    if end is not None:
        where = where & (F.col("called_at") <= end)
    return newest(calls, "called_at", "call_id", limit, 500, where, before)
