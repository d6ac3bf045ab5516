"""Lines that a site repeats on many of its pages.

A line's frequency is relative to its site: the pages of the host that hold it
over all pages of the host. Lines above a ratio are boilerplate and go; the
ratio alone decides, and is higher for small hosts. Lines
are counted by their 64-bit hash, once per page, combined before the shuffle.
Since pages hold few lines each, a host has at most (lines per page / ratio)
lines above the ratio; that short list is what is joined back to the pages, so
the texts themselves are never shuffled while the lists of all hosts are small
enough for the planner to broadcast, and by host otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.llm.common import col, free_name
from graphlog.storage import materialise


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\v"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", percent: int = 5, copies: bool = True) -> DataFrame:
    """(host, lines): hashes of the lines on more of a host's pages than its ratio allows.

    The ratio is ``percent`` of the pages, and higher the fewer they are:
    percent + (100 - percent) / sqrt(pages). So a line of two pages must be on
    both, one of nine on four, one of ten thousand on more than 5.95 percent,
    and a page alone loses nothing. A line is compared without the blanks around it; blank lines and pages of
    no host (null) are left out. Without ``copies``, pages of one host and
    text are one page, told by the text's 64-bit hash: a text given often is
    no boilerplate for that.
    """
    named = pages.filter(col(host).isNotNull()).select(col(host).alias("host"), col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _key(x) != ""), lambda x: F.xxhash64(_key(x))))
    hashed = named.select("host", F.xxhash64("text").alias("own"), keys.alias("keys"))
    if not copies:
        hashed = materialise(hashed.groupBy("host", "own").agg(F.first("keys").alias("keys")))
    total = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = hashed.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.col("pages") * percent + (100 - percent) * F.sqrt("pages")  # in percent of the pages
    often = seen.filter("n > 1").join(total, "host").filter(F.col("n") * 100 > allowed)
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", percent: int = 5,
                     n_lines: str | None = None, n_dropped: str | None = None, copies: bool = True) -> DataFrame:
    """``pages`` with the boilerplate lines of each host cut out of ``text``.

    The other lines keep their order and bytes. A null text stays null, an
    empty one empty; a page of nothing but boilerplate becomes empty; pages of
    a null host stay as they are. Repeated rows are pages of their own, unless
    ``copies`` says otherwise; an empty table stays empty. ``n_lines`` and ``n_dropped`` name columns
    for the number of non-blank lines and of those cut, if wanted; ``copies``
    is that of ``boilerplate``.
    """
    found = materialise(boilerplate(pages, host, text, percent, copies))
    site, bad = free_name(pages, "_site"), free_name(pages, "_bad")
    joined = pages.join(found.select(F.col("host").alias(site), F.col("lines").alias(bad)), col(host) == col(site), "left")
    lines = _lines(col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(col(bad), F.xxhash64(_key(x))) | (_key(x) == ""))
    after = F.when(col(bad).isNull(), col(text)).otherwise(F.array_join(kept, "\n"))
    more = []
    if n_lines:
        more.append(F.coalesce(F.size(F.filter(lines, lambda x: _key(x) != "")), F.lit(0)).cast("long").alias(n_lines))
    if n_dropped:
        cut = F.when(col(bad).isNull() | col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
        more.append(cut.cast("long").alias(n_dropped))
    return joined.select(*[after.alias(c) if c == text else col(c) for c in pages.columns], *more)
