import zlib
from collections import Counter, defaultdict

import odd
from pyspark.sql import functions as F

from graphlog.llm import queries, shards


def test_more_weight_draws_rows_only_to_its_own_subtree(spark):
    before = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0}}, "r1": {"k0": {3: 2.0, 4: 0.0}}}
    after = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0}}, "r1": {"k0": {3: 4.0, 4: 0.0}}}
    df = spark.range(4000).select(shards.assign(F.col("id"), before).alias("a"), shards.assign(F.col("id"), after).alias("b"))
    moves = Counter((r.a, r.b) for r in df.collect() if r.a != r.b)
    assert moves and {b for _, b in moves} == {3}
    shares = Counter(r.a for r in df.collect())
    assert 4 not in shares and abs(shares[3] / 4000 - 0.4) < 0.04 and abs(shares[0] / 4000 - 0.2) < 0.03


def test_a_new_shard_takes_rows_only_into_itself_and_places_depend_on_the_key_alone(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    rows = shards.place(df, "doc_id", shards.tree(16), shards.tree(17)).collect()
    assert {r.shard for r in rows} == set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert 0.03 < sum(r.grown_shard == 16 for r in rows) / 3000 < 0.09
    again = {r.doc_id: r.shard for r in shards.place(df.filter("doc_id % 7 = 0").repartition(5), "doc_id", shards.tree(16)).collect()}
    assert again == {r.doc_id: r.shard for r in rows if r.doc_id % 7 == 0}


def test_slots_have_no_gaps(spark):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["slot", "_slot", "_shard", "_range"])
    rows = shards.place(df.drop("_range"), "doc_id", shards.tree(16), shards.tree(17)).collect()
    assert len(rows) == len(data)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.place(odd.frame(spark, []), "doc_id", shards.tree(16)).count() == 0


def test_the_query_on_odd_rows(spark, tmp_path):
    data = odd.rows()
    odd.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op10_sharding"](spark, str(tmp_path)).collect()
    want = odd.ordered((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    assert odd.ordered((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"key"}


def test_nothing_with_weight(spark):
    assert spark.range(3).select(shards.assign(F.col("id"), {"r0": {"k0": {0: 0.0}}}).alias("s")).filter("s IS NOT NULL").count() == 0
