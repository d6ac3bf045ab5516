import random

import numpy as np
import odd
import pyarrow as pa
import pytest

from graphlog.llm import repeats


def plain(data, width):
    """Spans by id and place, as rows of one id are not earlier than each other at one place."""
    first = {}
    for r in data:
        text, i = (r[1] or "").encode(), r[0] if r[0] is not None else 1 << 63
        for at in range(len(text) - width + 1):
            w = text[at:at + width]
            first[w] = min(first.get(w, (i, at)), (i, at))
    out = []
    for r in data:
        text, i = (r[1] or "").encode(), r[0] if r[0] is not None else 1 << 63
        gone = bytearray(len(text))
        for at in range(len(text) - width + 1):
            if first[text[at:at + width]] < (i, at):
                gone[at:at + width] = b"\1" * width
        spans = [[a, a + 1] for a in range(len(text)) if gone[a]]
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        out.append((r[0], bytes(x for x, g in zip(text, gone, strict=True) if not g), [tuple(m) for m in merged]))
    return odd.ordered(out)


def found(df, width):
    done = repeats.remove_repeats(df, width=width)
    return odd.ordered((r.doc_id, bytes(r.kept), [(s.start, s.stop) for s in r.spans]) for r in done.collect())


@pytest.mark.parametrize("slice_bytes, batch, buckets", [(4 << 20, 1 << 16, 8 << 20), (3000, 40, 4000), (700, 7, 1000)])
def test_odd_rows_equal_all_windows(spark, monkeypatch, slice_bytes, batch, buckets):
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(repeats, "BATCH", batch)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", buckets)
    data = odd.rows()
    assert found(odd.clashing(odd.frame(spark, data), ["_id", "_part", "_text", "kept", "spans"]), 100) == plain(data, 100)


def test_passages_in_other_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 2500)
    monkeypatch.setattr(repeats, "BATCH", 60)
    rnd = random.Random(11)
    shared = [odd.prose(rnd, 40) for _ in range(6)]
    data = []
    for i in range(80):
        passage = rnd.choice(shared)
        a = rnd.randrange(40)
        data.append((i, odd.prose(rnd, 12) + passage[a: a + rnd.randint(80, 240)] + odd.prose(rnd, 9), "en", "a", 0))
    rnd.shuffle(data)
    want = plain(data, 100)
    assert found(odd.frame(spark, data), 100) == want and sum(len(r[2]) for r in want) > 20


@pytest.mark.parametrize("text", ["a" * 900, "ab" * 500, "abc " * 300, "x" * 99, "x" * 100, "x" * 101])
def test_texts_that_repeat_themselves(spark, text):
    data = [(1, text, "en", "a", 0), (2, "start " + text[:150] + " end", "en", "a", 0)]
    assert found(odd.frame(spark, data), 100) == plain(data, 100)


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1200)
    rnd = random.Random(12)
    long = odd.prose(rnd, 1500)
    data = [(1, long, "en", "a", 0), (2, long[3000:5200] + odd.prose(rnd, 60) + long[1100:1500], "en", "a", 0)]
    assert found(odd.frame(spark, data), 100) == plain(data, 100)


def test_empty_table(spark):
    assert repeats.remove_repeats(odd.frame(spark, [])).count() == 0


def test_levels_stay_logarithmic():
    import numpy as np

    family = repeats.Family()
    rnd = np.random.default_rng(1)
    for b in range(64):
        x = np.zeros(100, repeats._ENTRY)
        x["anchor"], x["hash"] = rnd.integers(0, 1 << 62, (2, 100), np.uint64)
        x["id"], x["n"] = np.arange(100) + 100 * b, 1
        assert not sum(len(r) for r in family.add(x))
        assert len(family.levels) <= 8
    again = sum(len(r) for r in family.add(x))
    assert again == 0  # the very entries once more are no repeats of themselves
    x["id"] += 1000
    assert sum(len(r) for r in family.add(x)) == 100


def test_spans_stay_with_their_text_beyond_65536_texts_of_an_id():
    rnd = random.Random(5)
    passage = odd.prose(rnd, 60)
    texts = ["a " + passage, odd.prose(rnd, 20) + passage]
    batch = pa.RecordBatch.from_arrays([pa.array([repeats._LAST] * 2), pa.array([5, 65_541], pa.int32()), pa.array(texts)], names=["_id", "_part", "_text"])
    rows = [r for b in repeats._index(100, 4)(iter([batch])) for r in b.to_pylist()]
    assert {r["part"] for r in rows if r["starts"]} == {65_541}


def test_entries_are_told_apart_by_id_start_part_and_hash():
    x = np.zeros(4, repeats._ENTRY)
    x["id"], x["start"], x["part"], x["hash"] = [5, 6, 6, 6], [2_000_010, 1_000_007, 1_000_007, 1_000_007], [0, 0, 70_000, 0], [7, 7, 7, 8]
    assert repeats._among(x, x[1:2]).tolist() == [False, True, False, False]
    assert repeats._among(x, x[[3, 0]]).tolist() == [True, False, False, True]
    assert not repeats._among(x[:0], x).any() and not repeats._among(x, x[:0]).any()
