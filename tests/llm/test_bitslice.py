import math

import numpy as np
import pytest

from graphlog.llm import bitslice


def plain(rows, k, queries):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if queries(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def search(spark, rows, k=10, block_rows=97, block_queries=3, queries=lambda i: i % 10 == 0):
    df = table(spark, [(*r, 0) for r in rows])
    asked = df.filter("vec_id % 10 = 0")
    found = bitslice.top_k(asked, bitslice.index(df, block_rows=block_rows), k, block_queries=block_queries)
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect()), plain(rows, k, queries)


@pytest.mark.parametrize("dims, scale", [(64, 0.125), (5, 3.0), (1, 1.0)])
def test_random_vectors(spark, dims, scale):
    rnd = np.random.default_rng(dims)
    rows = [(i, (rnd.normal(size=dims) * scale).astype(np.float32).tolist()) for i in range(400)]
    got, want = search(spark, rows)
    assert got == want


def test_ties_nulls_and_odd_lengths(spark):
    rows = [(i, [0.5, 0.25, -0.125]) for i in range(40)] + [(40 + i, [0.0, 0.0, 0.0]) for i in range(15)]
    rows += [(60, None), (70, [1.0, None, 2.0]), (80, [float("nan"), 0.0, 0.0]), (90, [float("inf"), 0.0, 0.0]), (100, []), (101, []), (110, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    got, want = search(spark, rows)
    assert got == want


def test_huge_components_are_scored_exactly(spark):
    rows = [(i, [46341.0 * (i - 7), -(2.0 ** 15), float(i)]) for i in range(30)]
    got, want = search(spark, rows)
    assert got == want


def test_fewer_rows_than_k_and_empty_tables(spark):
    got, want = search(spark, [(10, [1.0]), (11, [2.0]), (20, [-1.0])])
    assert got == want and len(got) == 4
    none = table(spark, [])
    assert bitslice.top_k(none, bitslice.index(none)).count() == 0
