"""Matching incoming entities to known ones: exact, by vector, by spelling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlog.storage import materialise

THRESHOLD = 0.7
NEIGHBOURS = 5
#: Vectors of one block; a task holds a block of each side.
BLOCK_BYTES = 8 << 20
#: Scores a task holds at once.
STRIP_BYTES = 32 << 20
#: Spelling scores below this are not worked out for the review queue.
REVIEW_FLOOR = 0.6
#: Most keys of a name that is listed under what deletions leave of it.
DELETIONS = 1000
#: Classes of letters whose counts tell names apart; all others are one more.
LETTERS = ["0123456789", " ", "aA", "eE", "iIjJyY", "oO", "uUvVwW", "nN", "rR", "sSzZ", "tT", "lL", "cCkKqQxX", "dDhH", "bBpPfF", "gGmM"]


def exact_matches(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(candidate_id, node, score): same tenant, type and name; smallest node."""
    named = nodes.filter(F.col("name").isNotNull()).groupBy("model_id", "type", "name").agg(F.min("node").alias("node"))
    hits = candidates.join(named, ["model_id", "type", "name"])
    return hits.select("candidate_id", "node", F.lit(1.0).alias("score"))


def upsert_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One vector per (tenant, node): the last write wins."""
    rows = stored.unionByName(fresh)
    rest = [c for c in rows.columns if c not in ("model_id", "node")]
    last = rows.groupBy("model_id", "node").agg(F.max_by(F.struct(*rest), "updated_at").alias("_l"))
    return last.select("model_id", "node", "_l.*")


_NEAR = "model_id string, query_id string, node string, score double"


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def _best(nodes: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best scores; equal scores by smallest node."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((nodes[near], -scores[near]))][:k]


def _rows(table: pa.Table, column: str, width: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.astype(np.float64).reshape(table.num_rows, width))


def _score(k: int, strip_bytes: int = STRIP_BYTES):
    def score(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "node": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            width = key[1].as_py()
            names = np.array(vectors.column("node").to_pylist(), dtype=str)
            known, asked = _rows(vectors, "vector", width).T, _rows(queries, "q", width)
            ids = queries.column("query_id").to_pylist()
            # a few queries at a time: two full blocks would make gigabytes of scores
            strip = max(1, strip_bytes // (8 * len(names)))
            for at in range(0, len(ids), strip):
                for query, own in zip(ids[at:at + strip], asked[at:at + strip] @ known, strict=True):
                    top = _best(names, own, k)
                    found["query_id"] += [query] * len(top)
                    found["node"] += names[top].tolist()
                    found["score"] += own[top].tolist()
        columns = [[key[0].as_py()] * len(found["node"]), *found.values()]
        kinds = [pa.string()] * 3 + [pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["model_id", *found])

    return score


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, model: str | None = None,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact k nearest vectors by cosine per query, within its tenant.

    ``queries`` has (model_id, query_id, vector), ``vectors`` has (model_id,
    node, vector) and perhaps ``embedding_model``; only vectors of one length
    meet. Both sides are dealt into blocks of a size taken from their counts,
    and each pair of blocks of a tenant is one group and one matrix product
    that keeps k per query. Nothing passes through the driver, and the number
    of jobs does not depend on the number of queries.
    """
    if model is not None and "embedding_model" in vectors.columns:
        vectors = vectors.filter(F.col("embedding_model") == model)

    def dealt(rows: DataFrame, name: str, vector: str, block: str, blocks: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.filter(F.col("vector").isNotNull()).select("model_id", name, F.col("vector").alias(vector), F.size("vector").alias("width"))
        per = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.greatest("width", F.lit(1)))))
        counts = rows.groupBy("model_id", "width").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(blocks))
        number = F.pmod(F.xxhash64(name), F.col(blocks)).cast("int").alias(block)
        return rows.join(counts, ["model_id", "width"]).select("model_id", "width", number, name, vector), counts

    known, known_blocks = dealt(vectors, "node", "vector", "block", "blocks")
    asked, asked_blocks = dealt(queries, "query_id", "q", "part", "parts")

    def to_all(rows: DataFrame, counts: DataFrame, blocks: str, block: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias(block)
        return rows.join(counts, ["model_id", "width"]).select(*rows.columns, every)

    left = to_all(known, asked_blocks, "parts", "part")
    right = to_all(asked, known_blocks, "blocks", "block").select(
        F.col("model_id").alias("_m"), F.col("width").alias("_w"), F.col("block").alias("_b"), F.col("part").alias("_p"), "query_id", "q"
    )
    pairs = left.groupBy("model_id", "width", "block", "part").cogroup(right.groupBy("_m", "_w", "_b", "_p"))
    found = pairs.applyInArrow(_score(k), _NEAR)
    order = Window.partitionBy("model_id", "query_id").orderBy(F.desc("score"), "node")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _reach(length: Column, threshold: float) -> Column:
    """Most edits a name of this length can be from any partner it may have."""
    return F.floor((1 - threshold) * length / threshold + 1e-9).cast("int")


def _grams(names: DataFrame, q: int) -> DataFrame:
    """Substrings of length q; repeats of one are told apart by a number."""
    spots = F.when(F.length("name") >= q, F.sequence(F.lit(1), F.length("name") - q + 1))
    cut = F.transform(spots, lambda i: F.substr(F.col("name"), i, F.lit(q)))
    rows = names.select("*", F.explode(cut).alias("gram"))
    counted = rows.groupBy(*names.columns, "gram").agg(F.count(F.lit(1)).alias("_times"))
    return counted.select(*names.columns, "gram", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("nth"))


def _edits(length: int, threshold: float) -> int:
    """Most edits between two names of which the longer has this length."""
    return math.floor((1 - threshold) * length + 1e-9)


def _too_short(threshold: float, q: int) -> float:
    """The greatest length of a name that may have a partner without enough grams, if there is one."""
    # n letters are too few if n - q + 1 <= q * reach, with reach at most (1 - threshold) / threshold * n
    slope = q + 1 - q / threshold
    return math.floor((q - 1) / slope / threshold + 1e-6) if slope > 1e-9 else math.inf


def _deletable(threshold: float, q: int) -> int:
    """The greatest length of names that are found by what deletions leave: where grams do, or keys get too many, it ends."""
    length, most = 0, _too_short(threshold, q)
    while length < most and sum(math.comb(length + 1, k) for k in range(_edits(length + 1, threshold) + 1)) <= DELETIONS:
        length += 1
    return length


def _deletions(names: DataFrame, threshold: float) -> DataFrame:
    """Each name with what is left of it after the edits allowed at most, once each; nth 0 tells them from grams."""

    def shorter(text: Column) -> Column:
        spots = F.sequence(F.lit(1), F.length(text))
        return F.transform(spots, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))

    def step(state: Column, _: Column) -> Column:
        last = F.array_distinct(F.flatten(F.transform(state["last"], shorter)))
        return F.struct(F.concat(state["every"], last).alias("every"), last.alias("last"))

    own = F.array("name")
    times = F.array_repeat(F.lit(1), F.floor((1 - threshold) * F.col("len") + 1e-9).cast("int"))
    left = F.aggregate(times, F.struct(own.alias("every"), own.alias("last")), step, lambda state: state["every"])
    return names.select("*", F.explode(left).alias("gram"), F.lit(0).alias("nth"))


def _lengths(threshold: float) -> Column:
    """All lengths that a partner of a name of length ``len`` may have."""
    low = F.ceil(F.col("len") * threshold - 1e-9).cast("int")
    return F.sequence(F.greatest(low, F.lit(1)), F.floor(F.col("len") / threshold + 1e-9).cast("int"))


def _counts(prefix: str) -> list[Column]:
    """How many letters of each class but the last a name has."""
    return [(F.col("len") - F.length(F.translate("name", c, ""))).alias(f"{prefix}{i}") for i, c in enumerate(LETTERS)]


def _by_letters(meeting: DataFrame, threshold: float) -> DataFrame:
    """(model_id, type, left_name, _la, right_name, _lb): names that meet on length and whose letters allow it.

    An edit changes the count of one class of letters each way, so the counts
    bound the edits from below. Names of equal counts are one shape, and it is
    shapes that are compared with shapes.
    """
    key, n = ["model_id", "type"], range(len(LETTERS))
    listed = meeting.filter("gram = '' AND nth > 0")
    a = materialise(listed.filter("left AND nth = len").select(*key, F.col("name").alias("left_name"), "len", *_counts("_a")))
    b = materialise(listed.filter("right").select(*key, F.col("name").alias("right_name"), F.col("len").alias("_lb"), *_counts("_b")))
    in_a, in_b = [f"_a{i}" for i in n], [f"_b{i}" for i in n]
    asked = a.select(*key, F.col("len").alias("_la"), *in_a, F.explode(_lengths(threshold)).alias("_lb")).distinct()
    rest = [F.col("_la") - sum((F.col(c) for c in in_a), F.lit(0)), F.col("_lb") - sum((F.col(c) for c in in_b), F.lit(0))]
    apart = sum((F.abs(F.col(x) - F.col(y)) for x, y in zip(in_a, in_b)), F.abs(rest[0] - rest[1]) + F.abs(F.col("_la") - F.col("_lb")))
    edits = F.floor((1 - threshold) * F.greatest("_la", "_lb") + 1e-9)
    shapes = asked.join(b.select(*key, "_lb", *in_b).distinct(), [*key, "_lb"]).filter(apart <= 2 * edits)
    # two shapes of one hash only bring more pairs to the test of the distance
    near = shapes.select(*key, "_la", "_lb", F.xxhash64(*in_a).alias("_l"), F.xxhash64(*in_b).alias("_r"))
    left = a.select(*key, "left_name", F.col("len").alias("_la"), F.xxhash64(*in_a).alias("_l"))
    right = b.select(*key, "right_name", "_lb", F.xxhash64(*in_b).alias("_r"))
    met = near.join(left, [*key, "_la", "_l"]).join(right, [*key, "_lb", "_r"])
    return met.select(*key, "left_name", "_la", "right_name", "_lb")


def _keys(names: DataFrame, threshold: float, q: int) -> DataFrame:
    """Names with the keys (gram, nth) on which they meet; see ``fuzzy_pairs``."""
    limit = _deletable(threshold, q)
    high = F.floor(F.col("len") / threshold + 1e-9).cast("int")
    # only names that may have a partner, or be one, beyond the limit
    longer = names.filter(high > limit)

    def short(length: Column) -> Column:
        return length - q + 1 <= _reach(length, threshold) * q

    # a name with too few grams meets all its partners on length
    grams = _grams(longer.filter(~short(F.col("len"))), q)
    common = grams.groupBy("model_id", "type", "gram", "nth").agg(F.count(F.lit(1)).alias("_often"))
    ordered = grams.join(common, ["model_id", "type", "gram", "nth"]).groupBy(*names.columns).agg(
        F.sort_array(F.collect_list(F.struct("_often", "gram", "nth"))).alias("_all")
    )
    prefix = F.slice("_all", F.lit(1), _reach(F.col("len"), threshold) * q + 1)
    rare = ordered.select(*names.columns, F.explode(prefix).alias("g")).select(*names.columns, "g.gram", F.col("g.nth").alias("nth"))
    keys = rare.unionByName(_deletions(names.filter(F.col("len") <= limit), threshold))

    if _too_short(threshold, q) <= limit:
        return keys
    lengths = _lengths(threshold)
    falls_back = longer.filter(short(F.col("len")) | F.exists(lengths, short))
    no, mark = F.lit(False), F.lit("").alias("gram")
    probes = falls_back.filter("left").select(*names.columns[:3], "left", no.alias("right"), "len", mark, F.explode(lengths).alias("nth"))
    bins = falls_back.filter("right").select(*names.columns[:3], no.alias("left"), "right", "len", mark, F.col("len").alias("nth"))
    return keys.unionByName(probes).unionByName(bins)


def fuzzy_pairs(candidates: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, q: int = 2) -> DataFrame:
    """Name pairs of one tenant and type that are at least ``threshold`` alike.

    Names are compared once each, however many rows carry them. Pairs meet in
    an equi-join, and the distance is only computed for those that meet; no
    similar pair is missed. Which keys they meet on depends on the longer one:

    * Where names can have too few grams (up to 10 letters at 0.7, 1 at 0.85),
      and with ``DELETIONS`` keys a name at most: two names within d edits leave
      the same letters when d are taken from the longer one, so each name is
      listed under all that deletions leave of it.
    * Beyond, two names within d edits lose at most q*d grams, so their q*d+1
      rarest grams (one global order) must meet.
    * Below a threshold of about 0.69 some names have too few grams and too many
      deletions; they meet on length, if the counts of their letters allow it.
    """
    key = ["model_id", "type", "name"]
    sides = candidates.select(*key, F.lit(True).alias("left"), F.lit(False).alias("right")).unionByName(
        nodes.select(*key, F.lit(False).alias("left"), F.lit(True).alias("right"))
    )
    named = sides.filter(F.length("name") > 0).groupBy(*key).agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    names = materialise(named.withColumn("len", F.length("name")))
    meeting = materialise(_keys(names, threshold, q))

    listed = meeting.filter("gram <> '' OR nth = 0")
    a = listed.filter("left").select("model_id", "type", "gram", "nth", F.col("name").alias("left_name"), F.col("len").alias("_la"))
    b = listed.filter("right").select("model_id", "type", "gram", "nth", F.col("name").alias("right_name"), F.col("len").alias("_lb"))
    longest = F.greatest("_la", "_lb")
    edits = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    # a short pair has one length of what deletions leave, a longer one no such keys
    limit = _deletable(threshold, q)
    own = F.when(longest <= limit, (F.col("nth") == 0) & (F.length("gram") == longest - edits)).otherwise(F.col("nth") > 0)
    met = a.join(b, ["model_id", "type", "gram", "nth"]).filter((F.abs(F.col("_la") - F.col("_lb")) <= edits) & own)
    met = met.select("model_id", "type", "left_name", "_la", "right_name", "_lb")
    if _too_short(threshold, q) > limit:
        met = met.unionByName(_by_letters(meeting, threshold).filter(longest > limit))
    # the distance is cut off at the edits allowed; few rows are left to make
    # distinct, and pairs that met on several grams are never shuffled
    apart = F.call_function("levenshtein", F.col("left_name"), F.col("right_name"), edits)
    near = met.withColumn("_apart", apart).filter(F.col("_apart") >= 0)
    scored = near.select("model_id", "type", "left_name", "right_name", (1.0 - F.col("_apart") / longest).alias("score"))
    return scored.filter(F.col("score") >= threshold).distinct()


def fuzzy_matches(candidates: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(candidate_id, node, score): the most alike node, smallest on ties."""
    named = nodes.groupBy("model_id", "type", "name").agg(F.min("node").alias("node"))
    pairs = fuzzy_pairs(candidates, nodes, threshold)
    scored = pairs.join(named.withColumnRenamed("name", "right_name"), ["model_id", "type", "right_name"])
    best = scored.groupBy("model_id", "type", F.col("left_name").alias("name")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "node")).alias("_b")
    )
    hits = candidates.select("candidate_id", "model_id", "type", "name").join(best, ["model_id", "type", "name"])
    return hits.select("candidate_id", F.col("_b.node").alias("node"), (-F.col("_b.s")).alias("score"))


def embedding_matches(candidates: DataFrame, nodes: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD,
                      model: str | None = None, k: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(matches, best): the first of the k nearest that is similar enough and
    of the wanted type, and the best score seen whether or not it matched.

    Candidates and nodes are of any number. Tables of short keys are packed
    so small that the planner, which goes by the size of files, would send
    millions of rows through the driver; so the joins with them are sorted ones.
    """
    asked = candidates.filter(F.col("vector").isNotNull())
    near = nearest(asked.select("model_id", F.col("candidate_id").cast("string").alias("query_id"), "vector"), vectors, k, model)
    typed = asked.select(F.col("candidate_id").cast("string").alias("query_id"), "candidate_id", "model_id", "type")
    rows = near.join(typed.hint("merge"), ["model_id", "query_id"])
    best = rows.groupBy("candidate_id").agg(F.max("score").alias("best"))
    known = nodes.select("model_id", "type", "node").hint("merge")
    fit = rows.filter(F.col("score") >= threshold).join(known, ["model_id", "type", "node"], "left_semi")
    matches = fit.groupBy("candidate_id").agg(F.min_by(F.struct("node", "score"), "rank").alias("_m"))
    return matches.select("candidate_id", "_m.*"), best


def resolve(candidates: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, threshold: float = THRESHOLD,
            model: str | None = None, review_floor: float = REVIEW_FLOOR) -> DataFrame:
    """MATCH with its tier and score, or NEEDS_REVIEW with the best score seen.

    Each tier runs on what the one before left over. A review row carries the
    better of the vector score and the spelling score; it is null if there is
    no vector score and no name is ``review_floor`` alike or more.
    """
    floor = min(review_floor, threshold)

    def tagged(df: DataFrame, tier: str) -> DataFrame:
        return df.select("candidate_id", F.lit("MATCH").alias("outcome"), F.lit(tier).alias("tier"), "node", "score")

    exact = tagged(exact_matches(candidates, nodes), "EXACT")
    # what a tier leaves over is written once: the next one reads it many times
    rest = materialise(candidates.join(exact.select("candidate_id"), "candidate_id", "left_anti"))
    found = exact
    best = None
    if vectors is not None:
        hits, best = embedding_matches(rest, nodes, vectors, threshold, model)
        hits, best = materialise(hits), materialise(best)
        found = found.unionByName(tagged(hits, "EMBEDDING"))
        rest = rest.join(hits.select("candidate_id"), "candidate_id", "left_anti")
    alike = materialise(fuzzy_matches(rest, nodes, floor))
    hits = alike.filter(F.col("score") >= threshold)
    found = found.unionByName(tagged(hits, "FUZZY"))
    left = rest.join(hits.select("candidate_id"), "candidate_id", "left_anti")
    left = left.join(alike.select("candidate_id", F.col("score").alias("_f")), "candidate_id", "left")
    score = F.col("_f")
    if best is not None:
        left = left.join(best, "candidate_id", "left")
        score = F.greatest(score, F.col("best"))  # nulls are passed over
    review = left.select(
        "candidate_id", F.lit("NEEDS_REVIEW").alias("outcome"), F.lit("ALL").alias("tier"),
        F.lit(None).cast("string").alias("node"), score.alias("score"),
    )
    return found.unionByName(review)
