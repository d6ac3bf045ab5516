"""Entity resolution, nearest vectors, and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlog.functions.literals import quote
from graphlog.functions.text import similarity
from graphlog.functions.vectors import cosine
from graphlog.operators import resolve, review, vectors
from workload.fixtures import at, table
from workload.registry import SQL, query

THRESHOLD = 0.85


def _known(spark, folder):
    """Parts as named nodes; large ones are of another type."""
    return table(spark, folder, "part").select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 2).cast("string")).alias("model_id"),
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"),
        F.when(F.col("p_size") < 40, "part").otherwise("tool").alias("type"),
        F.concat_ws(" ", "p_name", "p_brand").alias("name"),
    )


def _candidates(spark, folder):
    """Each part again: as it is, misspelt, or backwards; some with a vector.

    Parts are packed many times smaller than they are, so the files' size would have them broadcast at millions of rows.
    """
    name = F.concat_ws(" ", "p_name", "p_brand")
    parts = table(spark, folder, "part").hint("merge")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vector"))
    return parts.join(vectors, "p_partkey", "left").select(
        F.concat(F.lit("c:"), F.col("p_partkey").cast("string")).alias("candidate_id"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 2).cast("string")).alias("model_id"),
        F.lit("part").alias("type"),
        F.when(F.col("p_partkey") % 3 == 0, name)
        .when(F.col("p_partkey") % 3 == 1, F.regexp_replace(name, "i", "y"))
        .otherwise(F.reverse(name)).alias("name"),
        "vector",
    )


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")).alias("model_id"),
        F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("node"),
        F.when(F.col("label") < 8, "m1").otherwise("m2").alias("embedding_model"),
        F.col("embedding").alias("vector"),
    )


SQL_RESOLVE = """
known AS (SELECT concat('t', p_partkey % 2) AS model_id, concat('part:', p_partkey) AS node,
   CASE WHEN p_size < 40 THEN 'part' ELSE 'tool' END AS type, concat_ws(' ', p_name, p_brand) AS name FROM part),
cand AS (SELECT concat('c:', p_partkey) AS candidate_id, concat('t', p_partkey % 2) AS model_id, 'part' AS type,
   CASE p_partkey % 3 WHEN 0 THEN concat_ws(' ', p_name, p_brand) WHEN 1 THEN replace(concat_ws(' ', p_name, p_brand), 'i', 'y')
   ELSE reverse(concat_ws(' ', p_name, p_brand)) END AS name, p_partkey FROM part),
exact AS (SELECT c.candidate_id, min(k.node) AS node, 1.0 AS score FROM cand c JOIN known k USING (model_id, type, name) GROUP BY c.candidate_id),
vec AS (SELECT vec_id, concat('t', vec_id % 2) AS model_id, concat('part:', vec_id) AS node, CAST(embedding AS DOUBLE[]) AS v,
   CASE WHEN label < 8 THEN 'm1' ELSE 'm2' END AS embedding_model FROM embeddings),
ranked AS (SELECT q.vec_id, q.model_id, x.node, list_cosine_similarity(q.v, x.v) AS score,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.node) AS rank
   FROM vec q JOIN vec x ON q.model_id = x.model_id WHERE x.embedding_model = 'm1'),
near AS (SELECT concat('c:', p.p_partkey) AS candidate_id, r.* FROM ranked r JOIN part p ON p.p_partkey = r.vec_id WHERE r.rank <= 5)
"""
SQL_FUZZY = """
names AS (SELECT model_id, type, name, min(node) AS node FROM known GROUP BY model_id, type, name),
scored AS (SELECT c.model_id, c.type, c.name, k.node,
   1.0 - CAST(levenshtein(c.name, k.name) AS DOUBLE) / greatest(length(c.name), length(k.name)) AS score
   FROM (SELECT DISTINCT model_id, type, name FROM cand) c JOIN names k ON c.model_id = k.model_id AND c.type = k.type),
alike AS (SELECT model_id, type, name, max(score) AS score, min_by(node, (-score, node)) AS node FROM scored WHERE score >= 0.85 GROUP BY model_id, type, name),
fuzzy AS (SELECT c.candidate_id, a.node, a.score FROM cand c JOIN alike a USING (model_id, type, name)),
spelt AS (SELECT c.candidate_id, max(s.score) AS score FROM cand c JOIN scored s USING (model_id, type, name) WHERE s.score >= 0.6 GROUP BY c.candidate_id)
"""


@query("exact_match", "WITH" + SQL_RESOLVE + "SELECT candidate_id, node, score FROM exact")
def exact_match(spark, folder):
    return resolve.exact_matches(_candidates(spark, folder), _known(spark, folder))


@query("fuzzy_match", "WITH" + SQL_RESOLVE + "," + SQL_FUZZY + "SELECT candidate_id, node, round(score, 6) AS score FROM fuzzy")
def fuzzy_match(spark, folder):
    found = resolve.fuzzy_matches(_candidates(spark, folder), _known(spark, folder), THRESHOLD)
    return found.withColumn("score", F.round("score", 6))


@query(
    "fuzzy_score",
    """SELECT p_partkey, round(1.0 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)), 6) AS score FROM part""",
)
def fuzzy_score(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.round(similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query(
    "cosine_score",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_score(spark, folder):
    a = table(spark, folder, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query(
    "knn_cosine",
    "WITH" + SQL_RESOLVE + "SELECT concat('q:', vec_id) AS query_id, model_id, node, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5",
)
def knn_cosine(spark, folder):
    vectors = _vectors(spark, folder)
    queries = vectors.select("model_id", F.regexp_replace("node", "part:", "q:").alias("query_id"), "vector")
    found = resolve.nearest(queries, vectors, 5, model="m1")
    return found.select("query_id", "model_id", "node", F.round("score", 6).alias("score"), "rank")


@query("knn_inverted_file_all_cells", SQL["knn_cosine"])
def knn_inverted_file_all_cells(spark, folder):
    """Every cell probed, so that the result is the exact one and each indexed vector is needed."""
    known = _vectors(spark, folder)
    queries = known.select("model_id", F.regexp_replace("node", "part:", "q:").alias("query_id"), "vector")
    centres = vectors.train(known.filter("embedding_model = 'm1'"), 16)
    found = vectors.probe(queries, vectors.index(known, centres, "m1"), centres, 5, probes=16)
    return found.select("query_id", "model_id", "node", F.round("score", 6).alias("score"), "rank")


@query(
    "embedding_upsert",
    """SELECT concat('t', vec_id % 2) AS model_id, concat('part:', vec_id) AS node,
       round(CAST(CASE WHEN label % 2 = 0 THEN list_reverse(embedding)[1] ELSE embedding[1] END AS DOUBLE), 6) AS head FROM embeddings""",
)
def embedding_upsert(spark, folder):
    stored = _vectors(spark, folder).withColumn("updated_at", at("2024-01-01 00:00:00"))
    fresh = table(spark, folder, "embeddings").filter("label % 2 = 0").select(
        F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")).alias("model_id"),
        F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("node"),
        F.lit("m1").alias("embedding_model"), F.reverse("embedding").alias("vector"),
        at("2024-01-02 00:00:00").alias("updated_at"),
    )
    found = resolve.upsert_embeddings(stored, fresh)
    return found.select("model_id", "node", F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


SQL_TIERS = """,
e_fit AS (SELECT n.candidate_id, min(n.rank) AS rank FROM near n JOIN cand c USING (candidate_id) JOIN known k ON k.model_id = n.model_id AND k.node = n.node AND k.type = c.type
   WHERE n.score >= 0.85 AND n.candidate_id NOT IN (SELECT candidate_id FROM exact) GROUP BY n.candidate_id),
emb AS (SELECT n.candidate_id, n.node, n.score FROM near n JOIN e_fit f USING (candidate_id, rank)),
fuz AS (SELECT * FROM fuzzy WHERE candidate_id NOT IN (SELECT candidate_id FROM exact) AND candidate_id NOT IN (SELECT candidate_id FROM emb)),
tiers AS (
 SELECT candidate_id, 'MATCH' AS outcome, 'EXACT' AS tier, node, score FROM exact
 UNION ALL SELECT candidate_id, 'MATCH', 'EMBEDDING', node, score FROM emb
 UNION ALL SELECT candidate_id, 'MATCH', 'FUZZY', node, score FROM fuz
 UNION ALL SELECT c.candidate_id, 'NEEDS_REVIEW', 'ALL', NULL, greatest((SELECT max(score) FROM near n WHERE n.candidate_id = c.candidate_id), s.score)
  FROM cand c LEFT JOIN spelt s USING (candidate_id) WHERE candidate_id NOT IN (SELECT candidate_id FROM exact) AND candidate_id NOT IN (SELECT candidate_id FROM emb)
  AND candidate_id NOT IN (SELECT candidate_id FROM fuzzy))
"""


def _resolved(spark, folder):
    return resolve.resolve(_candidates(spark, folder), _known(spark, folder), _vectors(spark, folder), THRESHOLD, "m1")


@query(
    "embedding_match",
    "WITH" + SQL_RESOLVE + """, hit AS (SELECT n.candidate_id, min(n.rank) AS rank FROM near n JOIN known k ON k.model_id = n.model_id AND k.node = n.node AND k.type = 'part'
      WHERE n.score >= 0.85 GROUP BY n.candidate_id) SELECT candidate_id, node, round(score, 6) AS score FROM near JOIN hit USING (candidate_id, rank)""",
)
def embedding_match(spark, folder):
    hits, _ = resolve.embedding_matches(_candidates(spark, folder), _known(spark, folder), _vectors(spark, folder), THRESHOLD, "m1")
    return hits.select("candidate_id", "node", F.round("score", 6).alias("score"))


@query(
    "resolve_tiers",
    "WITH" + SQL_RESOLVE + "," + SQL_FUZZY + SQL_TIERS + "SELECT candidate_id, outcome, tier, node, round(score, 6) AS score FROM tiers",
)
def resolve_tiers(spark, folder):
    return _resolved(spark, folder).withColumn("score", F.round("score", 6))


def _queue(spark, folder):
    """Conversation turns waiting for review; system turns were decided."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("t"), (F.col("conv_id") % 2).cast("string")).alias("model_id"),
        F.concat_ws("-", "conv_id", "turn").alias("candidate_id"),
        F.concat(F.lit("c"), (F.col("turn") % 3).cast("string")).alias("connector_id"),
        F.col("role").alias("type"),
        F.create_map(F.lit("name"), quote(F.substring("text", 1, 20))).alias("payload"),
        F.concat(F.lit("doc-"), F.col("conv_id").cast("string")).alias("source_document_id"),
        F.lit("0:20").alias("source_chunk_range"),
        (at("2024-01-01 00:00:00") + F.make_interval(mins=F.col("conv_id"))).alias("created_at"),
        F.when(F.col("turn") == 0, "REJECTED").alias("decision"),
    )


@query(
    "review_pending",
    """SELECT concat_ws('-', conv_id, turn) AS candidate_id FROM conversations WHERE conv_id % 2 = 1 AND turn <> 0 AND turn % 3 = 1
       AND role = 'assistant' AND conv_id >= 10 ORDER BY conv_id, candidate_id LIMIT 50""",
)
def review_pending(spark, folder):
    since = at("2024-01-01 00:10:00")
    return review.pending(_queue(spark, folder), "t1", "c1", "assistant", since).select("candidate_id")


def _decisions(spark, folder):
    verdict = F.when(F.col("turn") % 3 == 0, "ACCEPTED").when(F.col("turn") % 3 == 1, "OVERRIDDEN").otherwise("REJECTED")
    return table(spark, folder, "conversations").filter("role = 'assistant' OR turn = 0").select(
        F.concat(F.lit("t"), (F.col("conv_id") % 2).cast("string")).alias("model_id"),
        F.concat_ws("-", "conv_id", "turn").alias("candidate_id"),
        verdict.alias("decision"),
        F.when(F.col("turn") % 3 == 1, F.concat(F.lit("node:"), F.col("conv_id").cast("string"))).alias("target"),
    )


@query(
    "review_decisions",
    """SELECT concat_ws('-', conv_id, turn) AS candidate_id, CASE WHEN turn % 3 = 1 THEN 'UPDATE' ELSE 'CREATE' END AS operation,
       CASE WHEN turn % 3 = 1 THEN concat('node:', conv_id) END AS node, 'extraction-review' AS source_system FROM conversations
       WHERE turn <> 0 AND role = 'assistant' AND turn % 3 <> 2""",
)
def review_decisions(spark, folder):
    _, made = review.decide(_queue(spark, folder), _decisions(spark, folder))
    return made.select("candidate_id", "operation", "node", "source_system")


@query(
    "review_state",
    """SELECT coalesce(CASE WHEN turn = 0 THEN 'REJECTED' WHEN role <> 'assistant' THEN NULL WHEN turn % 3 = 0 THEN 'ACCEPTED'
       WHEN turn % 3 = 1 THEN 'OVERRIDDEN' ELSE 'REJECTED' END, 'PENDING') AS decision, count(*) AS n FROM conversations GROUP BY 1""",
)
def review_state(spark, folder):
    queue, _ = review.decide(_queue(spark, folder), _decisions(spark, folder))
    return queue.groupBy(F.coalesce("decision", F.lit("PENDING")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_enqueue",
    "WITH" + SQL_RESOLVE + "," + SQL_FUZZY + SQL_TIERS + """SELECT c.candidate_id, t.tier AS resolution_tier, round(CAST(t.score AS DOUBLE), 5) AS resolution_score
      FROM tiers t JOIN cand c USING (candidate_id) WHERE t.outcome = 'NEEDS_REVIEW'""",
)
def review_enqueue(spark, folder):
    rows = review.enqueue(_candidates(spark, folder), _resolved(spark, folder), at("2024-01-01 00:00:00"))
    return rows.select("candidate_id", "resolution_tier", F.col("resolution_score").cast("double").alias("resolution_score"))


@query(
    "candidate_merge",
    "WITH" + SQL_RESOLVE + "," + SQL_FUZZY + SQL_TIERS + """SELECT t.candidate_id, t.node, c.name FROM tiers t JOIN cand c USING (candidate_id) WHERE t.outcome = 'MATCH'""",
)
def candidate_merge(spark, folder):
    return review.merge_matches(_candidates(spark, folder), _resolved(spark, folder)).select("candidate_id", "node", "name")
