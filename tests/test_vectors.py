from pyspark.sql import functions as F

from graphlog.operators import resolve, vectors

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def known(spark):
    rows = spark.read.parquet(EMBEDDINGS)
    return rows.select(F.concat(F.lit("t"), F.col("vec_id") % 2).alias("model_id"), F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vector"), "vec_id")


def asked(rows):
    return rows.filter("vec_id % 50 = 0").select("model_id", F.col("node").alias("query_id"), "vector")


def pairs(found):
    return {(r.model_id, r.query_id, r.node) for r in found.collect()}


def test_recall_on_every_fiftieth_vector_is_at_least_nine_tenths(spark):
    rows = known(spark)
    centres = vectors.train(rows, 32)
    made = vectors.index(rows, centres)
    assert made.count() == rows.count() and made.select("cell").distinct().count() > 8
    want = pairs(resolve.nearest(asked(rows), rows, 10))
    probes, recall = vectors.calibrate(asked(rows), rows, made, centres, 0.9, 10)
    got = pairs(vectors.probe(asked(rows), made, centres, 10, probes=probes))
    assert probes < 24 and recall >= 0.9  # of 32 cells, on vectors that hardly cluster
    assert abs(len(got & want) - recall * len(want)) < 1e-6


def test_clustered_vectors_need_few_probes(spark):
    centre = "transform(sequence(1, 16), i -> sin(i * (id % 20 + 1)) * 10 + sin(id * 12.9898 + i * 78.233))"
    rows = spark.range(2000).selectExpr("'t0' AS model_id", "cast(id AS string) AS node", "id AS vec_id", f"transform({centre}, x -> cast(x AS float)) AS vector")
    centres = vectors.train(rows, 20)
    probes, recall = vectors.calibrate(asked(rows), rows, vectors.index(rows, centres), centres, 0.9)
    assert probes <= 3 and recall >= 0.9


def test_all_probes_equal_the_exact_way_in_blocks(spark):
    rows = known(spark).filter("vec_id < 400")
    odd = spark.createDataFrame([("t0", "w1", [1.0, 2.0]), ("t0", "w2", [2.0, 1.0]), ("t0", "none", None), ("t1", "zero", [0.0] * 64)], "model_id string, node string, vector array<float>")
    rows = rows.drop("vec_id").unionByName(odd)
    queries = rows.select("model_id", F.col("node").alias("query_id"), "vector").filter("query_id IN ('0', '50', '51', 'w1', 'none', 'zero')")
    centres = vectors.train(rows, 9)
    found = vectors.probe(queries, vectors.index(rows, centres), centres, 5, probes=9, block_bytes=4096)
    key = ["model_id", "query_id", "rank", "node"]
    assert sorted(found.select(*key).collect()) == sorted(resolve.nearest(queries, rows, 5).select(*key).collect())


def test_no_vectors(spark):
    rows = known(spark).limit(0)
    centres = vectors.train(rows, 4)
    assert vectors.probe(asked(rows), vectors.index(rows, centres), centres).count() == 0
