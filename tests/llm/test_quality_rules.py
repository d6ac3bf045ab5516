import random

import odd
import pytest
from pyspark.sql import functions as F

from graphlog.llm import rules


def verdicts(spark, df, con):
    measured = rules.measure(df, ["doc_id", "lang", "source"])
    judged = rules.judge(measured, rules.fences(rules.sketches(measured)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = judged.select("doc_id", *[f"stats.{c}" for c in counts], "base_failed", "kept").collect()
    return odd.ordered(got), odd.ordered(con.execute(rules.SQL).fetchall())


def test_odd_rows_agree_with_the_sql(spark):
    data = odd.rows()
    got, want = verdicts(spark, odd.frame(spark, data), odd.duck(data))
    assert got == want


def test_large_groups_have_fences_of_their_own(spark):
    rnd = random.Random(2)
    data = []
    for i in range(900):
        source = "a" if i % 3 else "b"
        text = odd.prose(rnd, rnd.randint(20, 40), "abcdefgh" if source == "a" else "ab")
        if i % 50 == 0:
            text = " ".join(w + "$$$" for w in text.split(" "))
        data.append((i, text, "en", source, len(text)))
    got, want = verdicts(spark, odd.frame(spark, data), odd.duck(data))
    assert got == want
    assert {r[0] for r in got if not r[7]} >= set(range(0, 900, 50))
    assert sum(1 for r in got if r[7]) > 850


def test_sketches_merge_and_stay_within_a_thirty_second(spark):
    values = [*range(300), 1000, 12345, 999_999, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", rules.bucket(F.col("v")).alias("b"))
    rows = df.select("v", "b", rules.bucket_value(F.col("b")).alias("top")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.v <= r.top <= r.v + r.v // 32 for r in rows)


def test_clashing_names_and_empty_tables(spark):
    df = odd.clashing(odd.frame(spark, odd.rows()), ["_stats", "_text", "kept", "base_failed", "_k1"])
    measured = rules.measure(df, df.columns)
    judged = rules.judge(measured, rules.fences(rules.sketches(measured)))
    assert judged.columns[: len(df.columns)] == df.columns and judged.count() == df.count()
    none = rules.measure(odd.frame(spark, []), ["lang", "source"])
    assert rules.judge(none, rules.fences(rules.sketches(none))).count() == 0


@pytest.mark.parametrize("text, repeats", [("a b c d e a b c d e", 10), ("a b c d e f a b c d e", 10), ("a a a a a a", 6), ("a b c d", 0), ("", 0), (None, 0)])
def test_words_in_repeated_windows(spark, text, repeats):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rules.measure(df, ["doc_id"]).first().stats.n_repeat_words == repeats
