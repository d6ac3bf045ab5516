import pytest
from pyspark.sql import functions as F

from graphlog.operators import graph, read
from graphlog.sources.layout import NodeStore, stored_steps


def rows(spark, n):
    """Tenant t0 with most rows, of two types with gaps in their numbers, and a small tenant."""
    made = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "t1").otherwise("t0").alias("model_id"), F.concat(F.lit("n:"), "id").alias("node"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") * 3).alias("seq"),
        F.create_map(F.lit("k"), F.to_json(F.struct((F.col("id") % 7).alias("v")))).alias("props"),
        (F.col("id") % 5 == 0).alias("tombstoned"),
    )
    return made.withColumn("props", F.create_map(F.lit("k"), F.concat(F.lit('"'), (F.col("seq") % 7).cast("string"), F.lit('"'))))


def listed(df):
    return sorted(tuple(r) for r in df.select(*[c for c in df.columns if c != "props"]).collect())


def test_a_lookup_and_a_page_read_as_many_files_at_any_size(spark):
    counts = []
    for n in (2000, 20000):
        nodes = rows(spark, n)
        store = NodeStore.write(nodes, rows_per_file=250)
        assert len(spark.read.parquet(f"{store.path}/by_seq").inputFiles()) >= n // 500
        one, page = store.lookup("t0", "n:77"), store.page("t0", "b", after=900, limit=20)
        assert listed(one) == listed(read.lookup(nodes, "t0", "n:77")) and one.count() == 1
        assert listed(page) == listed(read.page(nodes, "t0", "b", after=900, limit=20)) and page.count() == 20
        counts.append((len(one.inputFiles()), len(page.inputFiles())))
    assert counts[0] == counts[1] and counts[0][0] == 1 and counts[0][1] <= 2


def test_pages_walk_through_everything(spark):
    nodes = rows(spark, 1500)
    store = NodeStore.write(nodes, rows_per_file=100)
    for tenant, kind, equal in (("t0", "a", {}), ("t1", "b", {}), ("t0", "b", {"k": "3"})):
        after, seen = 0, []
        while after is not None:
            page = store.filtered_page(tenant, kind, equal, after=after, limit=90).collect()
            seen += [r.seq for r in page]
            after = page[0].next_after if page else None
        want = read.typed_scan(nodes, tenant, kind).filter("seq > 0").filter(read.matching(equal))
        assert seen == sorted(r.seq for r in want.collect())


def test_absent_keys_tenants_and_empty_tables(spark):
    nodes = rows(spark, 300)
    store = NodeStore(spark, NodeStore.write(nodes, rows_per_file=20).path)
    assert store.lookup("t0", "none").count() == 0 and store.lookup("t9", "n:1").count() == 0
    assert store.page("t9", "a").count() == 0 and store.page("t0", "a", after=10**9).count() == 0
    keys = spark.createDataFrame([("t0", "n:1"), ("t0", "n:1"), ("t1", "n:2"), ("t9", "n:3"), (None, None)], "model_id string, node string")
    assert listed(store.lookup_many(keys)) == listed(read.lookup_many(nodes, keys))
    empty = NodeStore.write(nodes.limit(0))
    assert empty.lookup("t0", "n:1").columns == nodes.columns and empty.lookup("t0", "n:1").count() == 0
    assert empty.page("t0", "a").count() == 0 and empty.lookup_many(keys).count() == 0
    with pytest.raises(ValueError):
        store.page("t0", "a", limit=501)


def test_a_hop_does_not_shuffle_the_stored_steps(spark):
    edges = spark.range(4000).select(F.lit("t0").alias("model_id"), F.concat(F.lit("n:"), F.col("id") % 500).alias("src"), F.concat(F.lit("n:"), (F.col("id") * 31 + 7) % 500).alias("dst"), F.lit("L").alias("label"))
    roots = spark.createDataFrame([("t0", "n:1"), ("t0", "n:9")], "model_id string, node string")
    step = stored_steps(graph.steps(edges).distinct(), rows_per_bucket=500)
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        hop = roots.select("model_id", F.col("node").alias("a")).join(step, ["model_id", "a"])
        plan = hop._jdf.queryExecution().executedPlan().toString().split("\n")
        moved = [line for line in plan if "Exchange" in line]
        assert moved and all(":" in line.split("Exchange")[0] for line in moved), "\n".join(plan)  # on the roots' side alone
        assert any("Bucketed: true" in line for line in plan)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for found, want in ((graph.neighbourhood(None, roots, 2, step=step), graph.neighbourhood(edges, roots, 2)),
                        (graph.reach(None, roots, 2, step=step), graph.reach(edges, roots, 2, "both"))):
        assert sorted(found.collect()) == sorted(want.collect())
