"""Quality rules with limits that follow the corpus.

Fixed base rules reject what is broken in any corpus. Beyond them a text is
judged by its peers: mergeable quantile sketches of four rates are kept per
language and source, a fence is drawn from their quartiles, and texts outside
are rejected by a join with the fences.

A sketch is a histogram with buckets of at most 1/32 relative width, held as
rows (group, rate, bucket, count). Two sketches merge by adding counts, so
partial sketches combine before the shuffle, a language's sketch is the sum of
its sources' and the result does not depend on the order of merging.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphlog.llm.common import col, free_name, pieces, serve, tidy

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: rate -> (numerator, denominator, scale, least spread of its fence, whether low values are judged too)
RATES = {
    "word_length": ("word_chars", "n_words", 1000, 700, True),
    "symbols": ("n_symbols", "word_chars", 100_000, 1000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 30, False),
}
SPREADS = 6
LEAST_GROUP = 200


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    find = re.compile(r"[^\x20\x09-\x0D]+").findall

    def of(text: str) -> tuple[int, ...]:
        words = find(text)
        n = len(words)
        grams = Counter(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        repeated = 0
        if len(grams) < n - 4:
            upto = 0
            for i, g in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)):
                if grams[g] > 1:
                    repeated += i + 5 - max(upto, i)
                    upto = i + 5
        lines = [line for line in text.split("\n") if line and find(line)]
        symbols = sum(map(text.count, "#*$%&|<>"))
        return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, len(lines)

    kind = pa.struct([(s, pa.int64()) for s in STATS])
    serve("rules")
    for batch in (part for whole in batches for part in pieces(whole, "_text")):
        rows = [of(t or "") for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
        made = pa.array([dict(zip(STATS, r, strict=True)) for r in rows], kind)
        rest = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], made], names=[*[batch.schema.names[i] for i in rest], "_stats"])


def measure(docs: DataFrame, keep: list[str], text: str = "text", out: str = "stats") -> DataFrame:
    """The columns ``keep`` and a struct of counts of the whole text; a null text counts as empty."""
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[col(c).alias(n) for c, n in zip(keep, names, strict=True)], col(text).cast("string").alias("_text"))
    stats = StructType()
    for s in STATS:
        stats = stats.add(s, "long")
    done = source.mapInArrow(tidy(_count), source.drop("_text").schema.add("_stats", stats))
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_stats").alias(out))


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def rate(name: str, stats: str = "stats") -> Column:
    """A rate as a whole number; zero where there is nothing to divide by."""
    top, bottom, scale, *_ = RATES[name]
    down = F.col(f"{stats}.{bottom}")
    return F.when(down > 0, F.floor(F.lit(scale) * F.col(f"{stats}.{top}") / down)).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """Bucket of a whole number >= 0: exact below 64, then 32 to each doubling. Order is kept."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", value, shift)).cast("long")


def bucket_value(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor(b / 64).cast("int")
    return F.call_function("shiftleft", (b % 64 + 1).cast("long"), shift) - 1


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source", stats: str = "stats") -> DataFrame:
    """(lang, source, rate, bucket, n) of the texts that pass the base rules."""
    rates = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r, stats)).alias("bucket")) for r in RATES])
    rows = measured.filter(~base_failed(stats)).select(col(lang).alias("lang"), col(source).alias("source"), F.inline(rates))
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, least: int = LEAST_GROUP, spreads: int = SPREADS) -> DataFrame:
    """(lang, source, <rate>_low, <rate>_high): one row per group of the sketch.

    A group of fewer than ``least`` texts takes the fence of its language, and
    a small language that of the whole corpus: their sketches are the sums.
    A fence lies ``spreads`` interquartile ranges beyond the quartiles; the
    range counts as at least the rate's own minimum, so that uniform groups
    reject no one for a small difference.
    """

    def fence(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        run = Window.partitionBy(*keys, "rate").orderBy("bucket")
        whole = Window.partitionBy(*keys, "rate")
        ranked = merged.select("*", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("total"))
        quart = ranked.groupBy(*keys, "rate").agg(
            F.max("total").alias("total"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        )
        q1, q3 = bucket_value(F.col("q1")), bucket_value(F.col("q3"))
        floor = F.coalesce(*[F.when(F.col("rate") == r, F.lit(v[3])) for r, v in RATES.items()])
        reach = F.greatest(q3 - q1, floor) * spreads
        low = F.when(F.col("rate").isin([r for r, v in RATES.items() if v[4]]), q1 - reach)
        return quart.filter(F.col("total") >= (least if keys else 0)).select(*keys, "rate", low.alias("low"), (q3 + reach).alias("high"))

    groups = sketch.select("lang", "source", "rate").distinct()
    own = fence(["lang", "source"]).withColumnsRenamed({"lang": "_l", "source": "_s", "rate": "_r", "low": "low2", "high": "high2"})
    tongue = fence(["lang"]).withColumnsRenamed({"lang": "_l", "rate": "_r", "low": "low1", "high": "high1"})
    every = fence([]).withColumnsRenamed({"rate": "_r", "low": "low0", "high": "high0"})
    g = groups.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("rate") == F.col("_r")), "left").drop("_l", "_s", "_r")
    g = g.join(tongue, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rate") == F.col("_r")), "left").drop("_l", "_r")
    g = g.join(every, F.col("rate") == F.col("_r"), "left").drop("_r")
    low = F.when(F.col("high2").isNotNull(), F.col("low2")).when(F.col("high1").isNotNull(), F.col("low1")).otherwise(F.col("low0"))
    high = F.coalesce("high2", "high1", "high0")
    picks = []
    for r in RATES:
        here = F.col("rate") == r
        picks += [F.max(F.when(here, low)).alias(f"{r}_low"), F.max(F.when(here, high)).alias(f"{r}_high")]
    return g.groupBy("lang", "source").agg(*picks)


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", stats: str = "stats") -> DataFrame:
    """``measured`` with base_failed and kept.

    ``limits`` has one row per language and source; nulls are a group of their
    own. A group without limits has no text that passes the base rules.
    """
    own = limits.withColumnsRenamed({c: f"_lim_{c}" for c in limits.columns})
    same = col(lang).eqNullSafe(F.col("_lim_lang")) & col(source).eqNullSafe(F.col("_lim_source"))
    inside = F.lit(True)
    for r in RATES:
        v = rate(r, stats)
        inside = inside & (v <= F.col(f"_lim_{r}_high")) & (F.col(f"_lim_{r}_low").isNull() | (v >= F.col(f"_lim_{r}_low")))
    failed, kept = free_name(measured, "base_failed"), free_name(measured, "kept")
    joined = measured.join(own, same, "left")
    return joined.select(
        *[col(c) for c in measured.columns],
        base_failed(stats).alias(failed),
        (~base_failed(stats) & F.coalesce(inside, F.lit(True))).alias(kept),
    )


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT rid, pos, struct_pack(a := word, b := lead(word, 1) OVER o, c := lead(word, 2) OVER o, d := lead(word, 3) OVER o, e := lead(word, 4) OVER o) AS gram,
    lead(pos, 4) OVER o AS last_pos FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
h AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE last_pos IS NOT NULL),
rw AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM h, range(5) r(k) WHERE n > 1 GROUP BY rid),
li AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ld AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM li
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
s AS (SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
    FROM d LEFT JOIN rw USING (rid) LEFT JOIN ld USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
v AS (SELECT rid, lang, source, base_failed, unnest([
    {'rate': 'word_length', 'v': CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END, 'least': 700, 'low_too': true},
    {'rate': 'symbols', 'v': CASE WHEN word_chars > 0 THEN 100000 * n_symbols // word_chars ELSE 0 END, 'least': 1000, 'low_too': false},
    {'rate': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END, 'least': 100, 'low_too': false},
    {'rate': 'repeats', 'v': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END, 'least': 30, 'low_too': false}], recursive := true) FROM b),
x AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS sh FROM v),
p AS (SELECT *, (((v >> sh) + 1) << sh) - 1 AS bv FROM x),
q AS (SELECT *, quantile_disc(bv, 0.25) OVER own AS a1, quantile_disc(bv, 0.75) OVER own AS b1, count(*) OVER own AS c1,
    quantile_disc(bv, 0.25) OVER lan AS a2, quantile_disc(bv, 0.75) OVER lan AS b2, count(*) OVER lan AS c2,
    quantile_disc(bv, 0.25) OVER every AS a3, quantile_disc(bv, 0.75) OVER every AS b3
    FROM p WHERE NOT base_failed
    WINDOW own AS (PARTITION BY rate, lang, source), lan AS (PARTITION BY rate, lang), every AS (PARTITION BY rate)),
y AS (SELECT rid, v, low_too, CASE WHEN c1 >= 200 THEN a1 WHEN c2 >= 200 THEN a2 ELSE a3 END AS q1,
    CASE WHEN c1 >= 200 THEN b1 WHEN c2 >= 200 THEN b2 ELSE b3 END AS q3, least FROM q),
z AS (SELECT rid, bool_and(v <= q3 + 6 * greatest(q3 - q1, least) AND (NOT low_too OR v >= q1 - 6 * greatest(q3 - q1, least))) AS inside FROM y GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
FROM b LEFT JOIN z USING (rid)
"""
