"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, held to a number of
epochs of what it has; what is above goes to the others by weight. Whole
epochs are taken first. The rest is a weighted sample without replacement: a
document of quality w draws the key -ln(u) / w, and documents are taken in
the order of their keys until the words are spent.

Order and running sums never need a whole source in one task: keys fall into
slices, slices are summed before the shuffle, and only the slice in which the
words run out is put in order. The outcome is one cut per source, so a row is
decided by a join with a table of one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.llm.common import WORD, col, free_name, uniform
from graphlog.storage import materialise

WEIGHTS = (5, 2, 1)
SLICE_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column) -> Column:
    """Default quality weight, below 1 and rising with the length: size / (size + 50)."""
    return size / (size + F.lit(50))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 100, epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. Sources whose
    share is above ``epochs`` times their size are filled in the order of
    size over weight; the first that is not decides the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = totals.select("source", "source_size", weigh.cast("long").alias("w"), (F.col("source_size") * epochs).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    sums = rows.select(
        "*",
        F.floor(F.sum("source_size").over(whole) * F.lit(share) / F.lit(100)).cast("long").alias("all"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("filled"),
        (F.sum("w").over(whole) - F.sum("w").over(upto) + F.col("w")).alias("open"),
    )
    level = (F.col("all") - F.col("filled")).cast("double") / F.col("open")
    marked = sums.withColumn("full", level * F.col("w") >= F.col("cap"))
    # filled and open of the first source that is not full; those before it are full
    at = marked.withColumn("_f", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("filled"), F.col("open")))).over(whole))
    rest = (F.col("w") * (F.col("all") - F.col("_f.filled"))).cast("double") / F.col("_f.open")
    return at.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 100, epochs: int = 3) -> DataFrame:
    """(source, source_size, target, epochs, last_slice, cut_key, cut_id) per source.

    ``sized`` has (id, source, size, key, slice).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    goal = goal.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialise(goal)
    g = goal.select(F.col("source").alias("_s"), F.col("rest").alias("_rest"))
    run = Window.partitionBy("source").orderBy("slice")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(run))
    last = (
        slices.join(g, F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("upto") >= F.col("_rest"))
        .groupBy("_s").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"), "_rest")).alias("m"))
        .select("_s", F.col("m.slice").alias("last_slice"), F.col("m.before").alias("before"), F.col("m._rest").alias("_rest"))
    )
    last = materialise(last)
    inside = sized.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("last_slice")))
    alike = inside.groupBy("_s", "before", "_rest", "key", "id").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("_s").orderBy("key", F.col("id").asc_nulls_first())
    near = alike.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter(2 * F.col("upto") - F.col("n") <= 2 * F.col("_rest"))
    cut = near.groupBy("_s").agg(F.max(F.struct("key", F.col("id").isNotNull().alias("named"), "id")).alias("c"))
    out = goal.join(last.select(F.col("_s").alias("_s1"), "last_slice"), F.col("source").eqNullSafe(F.col("_s1")), "left")
    out = out.join(cut.select(F.col("_s").alias("_s2"), "c"), F.col("source").eqNullSafe(F.col("_s2")), "left")
    return materialise(out.select("source", "source_size", "target", "epochs", "last_slice", F.col("c.key").alias("cut_key"), F.col("c.id").alias("cut_id")))


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
        weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: int = 100, epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, times and taken.

    ``times`` is how often the mix takes the row: the source's whole epochs,
    and once more if its key comes before the source's cut. ``size`` defaults
    to the words of ``text`` (null: 0), ``weight`` to :func:`quality`; a
    weight of null or not above zero comes last. The row at the cut is taken
    if that leaves the source nearer its target. Rows of one id and key are
    taken or left together; equal runs give equal results. A null source is a
    source of its own. Nothing is dropped: rows not taken have times 0.
    """
    names = {n: free_name(docs, n) for n in ("_size", "_key", "_slice")}
    rated = docs.withColumn(names["_size"], words(col(text)) if size is None else F.coalesce(size, F.lit(0)).cast("long"))
    w = quality(col(names["_size"])) if weight is None else weight.cast("double")
    draw = -F.log(uniform(F.lit(seed), col(id_column)))
    key = F.when(w > 0, draw / F.when(w > 0, w)).otherwise(F.lit(float("inf")))
    rated = rated.withColumn(names["_key"], key)
    slim = materialise(rated.select(col(id_column).alias("id"), col(source).alias("source"), col(names["_size"]).alias("size"), col(names["_key"]).alias("key")))
    slices = max(64, slim.count() // SLICE_ROWS)
    cut_slice = F.floor((1 - F.exp(-F.col("key"))) * slices).cast("long")
    goal = plan(slim.withColumn("slice", cut_slice), weights, share, epochs)
    g = goal.withColumnsRenamed({c: f"_g_{c}" for c in goal.columns})
    joined = rated.join(g, col(source).eqNullSafe(F.col("_g_source")), "left")
    k, mine = col(names["_key"]), F.floor((1 - F.exp(-col(names["_key"]))) * slices).cast("long")
    before_id = F.col("_g_cut_id").eqNullSafe(col(id_column)) | col(id_column).isNull() | (col(id_column) < F.col("_g_cut_id"))
    at_cut = F.col("_g_cut_key").isNotNull() & ((k < F.col("_g_cut_key")) | ((k == F.col("_g_cut_key")) & F.coalesce(before_id, F.lit(False))))
    picked = F.coalesce((mine < F.col("_g_last_slice")) | ((mine == F.col("_g_last_slice")) & at_cut), F.lit(False))
    times = (F.coalesce(F.col("_g_epochs"), F.lit(0)) + picked.cast("long")).cast("long")
    made = {"size": col(names["_size"]), "source_size": F.col("_g_source_size"), "target": F.col("_g_target"), "times": times, "taken": times * col(names["_size"])}
    keep = [c for c in docs.columns if c.lower() not in made]
    return joined.select(*[col(c) for c in keep], *[v.alias(n) for n, v in made.items()])


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    slot = free_name(docs, "_times")
    kept = docs.withColumn(slot, F.struct(*[col(c) for c in docs.columns]))
    mixed = mix(kept, **options).filter("times > 0")
    again = mixed.select(col(slot), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_n"))
    return again.select(*[col(slot).getField(c).alias(c) for c in docs.columns])


SQL = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
    / nullif(size / (size + 50), 0) AS key FROM s),
t AS (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * n AS cap FROM t),
f AS (SELECT *, sum(n) OVER ()::BIGINT AS total, (sum(cap) OVER o - cap)::BIGINT AS filled, (sum(w) OVER () - sum(w) OVER o + w)::BIGINT AS open
    FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
m AS (SELECT *, (total - filled)::DOUBLE / open * w >= cap AS is_full FROM f),
l AS (SELECT filled AS lf, open AS lo FROM m WHERE NOT is_full ORDER BY filled LIMIT 1),
g AS (SELECT source, n, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * (total - lf))::DOUBLE / lo END AS target FROM m LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n)) ELSE 0 END::BIGINT AS e FROM g),
r AS (SELECT k.*, e.n, e.target, e.e, e.target - e.e * e.n AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key NULLS LAST, doc_id NULLS FIRST)::BIGINT AS upto
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target, (size * (e + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
