import random

import odd
from pyspark.sql import functions as F

from graphlog.llm import mix


def result(df, **options):
    return odd.ordered(mix.mix(df, **options).select("doc_id", "size", "source_size", "target", "taken").collect())


def test_odd_rows_agree_with_the_sql(spark):
    data = [r for r in odd.rows() if r[0] is not None]  # the SQL orders rows of one key singly
    seen = {}
    data = [r for r in data if seen.setdefault(r[0], r) is r]
    got, want = result(odd.frame(spark, data)), odd.ordered(odd.duck(data).execute(mix.SQL).fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_shares_caps_and_nearness(spark):
    rnd = random.Random(4)
    sizes = {"a": 40, "b": 300, "c": 150, "d": 700, None: 90}
    data = [(i, odd.prose(rnd, rnd.randint(1, 60)), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    found = mix.mix(odd.frame(spark, data)).collect()
    total = sum(r["size"] for r in found)
    by = {}
    for r in found:
        s = by.setdefault(r.source, {"size": 0, "taken": 0, "target": r.target, "most": 0})
        s["size"] += r["size"]
        s["taken"] += r.taken
        s["most"] = max(s["most"], r["size"])
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
    assert abs(sum(s["target"] for s in by.values()) - total) < 1e-6
    for s in by.values():
        assert abs(s["taken"] - s["target"]) <= s["most"] / 2 + 1e-9 and s["target"] <= 3 * s["size"] + 1e-9
    level = {k: by[k]["target"] / w for k, w in zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2), strict=True)}
    unfilled = [v for k, v in level.items() if by[k]["target"] < 3 * by[k]["size"] - 1e-6]
    assert max(unfilled) - min(unfilled) < 1e-6


def test_reruns_and_other_partitions_agree(spark):
    data = odd.rows()
    assert result(odd.frame(spark, data)) == result(odd.frame(spark, data[::-1]).repartition(7))


def test_heavier_documents_are_taken_more_often(spark):
    data = [(i, "w " * 10, "en", "a", 0) for i in range(4000)]
    df = odd.frame(spark, data).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    found = mix.mix(df, weight=F.col("q"), share=30).groupBy("q").agg(F.sum("times").alias("n")).collect()
    n = {r.q: r.n for r in found}
    assert abs(n[3.0] + n[1.0] - 1200) <= 1 and 2.0 < n[3.0] / n[1.0] < 3.5


def test_the_mix_repeats_rows_and_keeps_columns(spark):
    df = odd.clashing(odd.frame(spark, odd.rows()), ["size", "times", "taken", "_key", "_size", "_times"])
    mixed = mix.repeat(df)
    assert mixed.columns == df.columns
    plan = mix.mix(df)
    assert mixed.count() == plan.agg(F.sum("times")).first()[0]


def test_empty_tables_and_texts_without_words(spark):
    assert mix.mix(odd.frame(spark, [])).count() == 0
    found = mix.mix(odd.frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])).collect()
    assert [r.taken for r in found] == [0, 0]
