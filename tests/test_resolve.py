import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlog.functions.text import similarity
from graphlog.operators import resolve, review

NODES = "model_id string, node string, type string, name string"
CANDS = "candidate_id string, model_id string, type string, name string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def score(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


@pytest.mark.parametrize("a,b,want", [("Jon Smith", "John Smith", 0.9), ("IBM", "International Business Machines", None), ("", "x", 0.0), (None, "x", 0.0)])
def test_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(similarity(F.col("a"), F.col("b"))).first()[0]
    assert got < 0.85 if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_blocking_misses_no_pair(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    stems = ["anna", "annabel", "bob", "jo", "x", "müller & söhne", "global trading ltd", "aaaaaaaaaa", "global shipping ltd"]

    def name():
        letters = list(rnd.choice(stems))
        for _ in range(rnd.randrange(4)):
            spot = rnd.randrange(len(letters) + 1)
            step = rnd.randrange(3)
            if step == 0:
                letters.insert(spot, rnd.choice("abcxyz "))
            elif letters and step == 1:
                letters.pop(min(spot, len(letters) - 1))
            elif letters:
                letters[min(spot, len(letters) - 1)] = rnd.choice("abc")
        return "".join(letters)

    nodes = [(f"t{rnd.randrange(2)}", f"n{i:03}", rnd.choice(["p", "q"]), name()) for i in range(150)]
    cands = [(f"c{i}", f"t{rnd.randrange(2)}", rnd.choice(["p", "q"]), name()) for i in range(150)]
    n, c = spark.createDataFrame(nodes, NODES), spark.createDataFrame(cands, CANDS)
    want = {
        (m, t, a, b) for _, m, t, a in cands for m2, _, t2, b in nodes if (m, t) == (m2, t2) and a and b and score(a, b) >= threshold
    }
    got = {(r.model_id, r.type, r.left_name, r.right_name) for r in resolve.fuzzy_pairs(c, n, threshold).collect()}
    assert got == want
    best = {r.candidate_id: (r.node, round(r.score, 9)) for r in resolve.fuzzy_matches(c, n, threshold).collect()}
    for cid, m, t, a in cands:
        options = [(-round(score(a, b), 9), node) for m2, node, t2, b in nodes if (m, t) == (m2, t2) and a and b and score(a, b) >= threshold]
        assert best.get(cid) == ((min(options)[1], -min(options)[0]) if options else None)


@pytest.mark.parametrize("threshold", [0.6, 0.67, 0.7, 0.85, 1.0])
def test_all_short_words_meet_their_like(spark, threshold):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abé"[: 3 if n < 4 else 2], repeat=n)] + ["ab" * 7, "ab" * 6 + "x", "b" + "ab" * 6, "xyz" * 5]
    rows = spark.createDataFrame([("t", f"n{i}", "p", w) for i, w in enumerate(words)], NODES)
    asked = spark.createDataFrame([(f"c{i}", "t", "p", w) for i, w in enumerate(words)], CANDS)
    want = {(a, b) for a in words for b in words if score(a, b) >= threshold - 1e-12}
    got = [(r.left_name, r.right_name) for r in resolve.fuzzy_pairs(asked, rows, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_what_deletions_leave(spark):
    names = spark.createDataFrame([("t", "p", "abca", True, True, 4), ("t", "p", "é", True, False, 1)], "model_id string, type string, name string, left boolean, right boolean, len int")
    got = sorted((r.name, r.gram, r.nth) for r in resolve._deletions(names, 0.5).collect())
    assert got == sorted([("abca", x, 0) for x in ("abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab")] + [("é", "é", 0)])


@pytest.mark.parametrize("threshold,by_length", [(0.6, True), (0.7, False), (0.85, False), (1.0, False)])
def test_names_meet_on_length_below_the_usual_threshold_only(spark, threshold, by_length):
    words = ["a" * n for n in range(1, 40)]
    names = spark.createDataFrame([("t", "p", w, True, True, len(w)) for w in words], "model_id string, type string, name string, left boolean, right boolean, len int")
    keys = resolve._keys(names, threshold, 2)
    assert bool(keys.filter("gram = ''").count()) == by_length
    most = keys.filter("nth = 0").groupBy("name").count().agg(F.max("count")).first()[0]
    assert most <= resolve.DELETIONS


def test_strangers_of_one_length_are_not_compared(spark):
    rows = [("t", f"n{i}", "p", f"large ring Brand#{i}") for i in range(200)]
    strangers = [("c%d" % i, "t", "p", f"0123456789 stranger {i:05}") for i in range(200)] + [("c", "t", "p", "large rings Brad#7")]
    names = spark.createDataFrame(rows, NODES).selectExpr("model_id", "type", "name", "false AS left", "true AS right", "length(name) AS len").unionByName(
        spark.createDataFrame(strangers, CANDS).selectExpr("model_id", "type", "name", "true AS left", "false AS right", "length(name) AS len"))
    keys = resolve._keys(names, 0.6, 2)
    assert keys.filter("len > 12 AND gram <> '' AND nth > 0").count() == 0
    assert {r.left_name for r in resolve._by_letters(keys, 0.6).collect()} == {"large rings Brad#7"}


@pytest.mark.parametrize("block", [1, 500, 1 << 20])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vectors = [(f"t{i % 2}", f"n{i:03}", "m1" if i % 5 else "m2", rng.normal(size=6).tolist()) for i in range(120)]
    queries = [(f"t{i % 2}", f"q{i}", rng.normal(size=6).tolist()) for i in range(9)]
    v = spark.createDataFrame(vectors, "model_id string, node string, embedding_model string, vector array<double>").repartition(5)
    q = spark.createDataFrame(queries, "model_id string, query_id string, vector array<double>")
    got = resolve.nearest(q, v, 4, "m1", block_bytes=block).orderBy("query_id", "rank").collect()
    for model, qid, vec in queries:
        cos = sorted((-np.dot(vec, w) / np.linalg.norm(vec) / np.linalg.norm(w), n) for m, n, e, w in vectors if m == model and e == "m1")
        assert [(r.node, round(r.score, 9)) for r in got if r.query_id == qid] == [(n, round(-s, 9)) for s, n in cos[:4]]


def test_scores_are_made_a_strip_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4000, 8))
    table = {name: pa.table({ids: [f"n{i:04}" for i in range(4000)], name: pa.array(rows.tolist(), pa.list_(pa.float64()))})
             for ids, name in (("node", "vector"), ("query_id", "q"))}
    key = (pa.scalar("t"), pa.scalar(8))
    tracemalloc.start()
    got = resolve._score(3, 1 << 20)(key, table["vector"], table["q"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all scores at once are 128 MB
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    assert got.column("query_id").to_pylist() == [f"n{i:04}" for i in range(4000) for _ in range(3)]
    assert got.column("node").to_pylist() == [f"n{j:04}" for row in want.tolist() for j in row]


def test_tiers(spark):
    nodes = spark.createDataFrame(
        [("t0", "n1", "person", "Jon Smith"), ("t0", "n2", "person", "Ada"), ("t0", "n3", "tool", "Axe"), ("t1", "n4", "person", "Zed Zedson")], NODES
    )
    vectors = spark.createDataFrame([("t0", "n2", [1.0, 0.0]), ("t0", "n3", [0.0, 1.0])], "model_id string, node string, vector array<double>")
    cands = spark.createDataFrame(
        [("exact", "t0", "person", "Ada", None), ("fuzzy", "t0", "person", "John Smith", None), ("vec", "t0", "person", "Countess", [0.92, 0.39]),
         ("typed", "t0", "person", "Hatchet", [0.0, 1.0]), ("other", "t0", "person", "Zed Zedson", None)],
        CANDS + ", vector array<double>",
    )
    got = {r.candidate_id: (r.outcome, r.tier, r.node) for r in resolve.resolve(cands, nodes, vectors, 0.85).collect()}
    assert got == {
        "exact": ("MATCH", "EXACT", "n2"), "fuzzy": ("MATCH", "FUZZY", "n1"), "vec": ("MATCH", "EMBEDDING", "n2"),
        "typed": ("NEEDS_REVIEW", "ALL", None), "other": ("NEEDS_REVIEW", "ALL", None),
    }
    review_score = {r.candidate_id: r.score for r in resolve.resolve(cands, nodes, vectors, 0.85).filter("node is null").collect()}
    assert review_score["typed"] == pytest.approx(1.0) and review_score["other"] is None
    near = resolve.resolve(cands.filter("candidate_id = 'fuzzy'"), nodes, None, 0.95).first()
    assert (near.outcome, near.score) == ("NEEDS_REVIEW", pytest.approx(0.9))
    floor = resolve.resolve(cands.filter("candidate_id = 'fuzzy'"), nodes, None, 0.95, review_floor=0.5).first()
    assert (floor.outcome, floor.score) == ("NEEDS_REVIEW", pytest.approx(0.9))


def test_decisions_act_once(spark):
    queue = spark.createDataFrame(
        [("t0", "a", None), ("t0", "b", None), ("t0", "c", None), ("t0", "d", "REJECTED"), ("t1", "a", None)], "model_id string, candidate_id string, decision string"
    ).selectExpr("*", "'person' AS type", "map('name', '\"x\"') AS payload", "'doc' AS source_document_id", "'0:1' AS source_chunk_range")
    said = spark.createDataFrame(
        [("t0", "a", "ACCEPTED", None), ("t0", "b", "OVERRIDDEN", "n9"), ("t0", "c", "REJECTED", None), ("t0", "d", "ACCEPTED", None)],
        "model_id string, candidate_id string, decision string, target string",
    )
    updated, made = review.decide(queue, said)
    assert {(r.model_id, r.candidate_id): r.decision for r in updated.collect()} == {
        ("t0", "a"): "ACCEPTED", ("t0", "b"): "OVERRIDDEN", ("t0", "c"): "REJECTED", ("t0", "d"): "REJECTED", ("t1", "a"): None,
    }
    assert {r.candidate_id: (r.operation, r.node) for r in made.collect()} == {"a": ("CREATE", None), "b": ("UPDATE", "n9")}


def test_the_embedding_match_sends_no_parts_through_the_driver(spark, tmp_path):
    from workload.resolve_queries import embedding_match

    parts = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, cast(id % 50 AS int) AS p_size, 1.0D AS p_retailprice"
    spark.range(400).selectExpr(*parts.split(", ")).write.parquet(str(tmp_path / "part.parquet"))
    vector = "transform(sequence(1, 8), i -> cast(sin(i * (id + 1)) AS float)) AS embedding"
    spark.range(60).selectExpr("id AS vec_id", vector, "cast(id % 10 AS int) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = embedding_match(spark, str(tmp_path))
    # files far smaller than their rows must not decide it
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [below.split("+- ")[-1] for line, below in zip(plan, plan[1:], strict=False) if "BroadcastExchange" in line]
    assert [x for x in sent if "p_partkey" in x] == []
    # each vector of the first model is its own nearest, and small parts are of the wanted type
    got = {r.candidate_id: (r.node, r.score) for r in found.collect()}
    assert {k: v for k, v in got.items() if v == (k.replace("c:", "part:"), 1.0)}.keys() == {f"c:{i}" for i in range(60) if i % 10 < 8 and i % 50 < 40}
