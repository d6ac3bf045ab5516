import random
import re

import odd
import pytest

from graphlog.llm import jaccard


def sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(data):
    """(id, size, smallest id connected) over all pairs."""
    held = [sets(r[1]) for r in data]
    tree = list(range(len(held)))

    def find(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i in range(len(held)):
        for j in range(i):
            if held[i] and held[j] and 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j]):
                tree[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return odd.ordered((r[0], len(held[i]), low.get(find(i))) for i, r in enumerate(data))


def near(seed=31, size=50):
    """Texts on both sides of 0.8, sharing a passage, some of little else."""
    rnd = random.Random(seed)
    passage = odd.prose(rnd, 30).replace("\n", " ")
    base = [odd.prose(rnd, rnd.choice([3, 6, 12, 60, 90, 220])).replace("\n", " ") + (" " + passage if i % 3 == 0 else "") for i in range(size)]
    texts = list(base)
    for t in base:
        for share in (0.02, 0.04, 0.08, 0.1, 0.14):
            words = t.split(" ")
            at = rnd.randrange(max(1, len(words) // 2))
            for k in range(max(1, int(share * len(words)))):
                words[min(at + k, len(words) - 1)] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [passage, passage + " more", passage.upper(), "", None, "one", "one", "One", " \n", "two words", "words two"]
    texts += [f"{passage} {passage} {i}" for i in range(30)] + [odd.prose(rnd, 3000), texts[5], texts[5]]
    return [(i, t, "en", "a", 0) for i, t in enumerate(texts)]


def test_equals_all_pairs_with_any_limits(spark, monkeypatch):
    data = near()
    want = plain(data)
    assert 60 < len({r[2] for r in want}) < len(data) - 40
    df = odd.frame(spark, data)
    assert odd.ordered(jaccard.join(df).collect()) == want
    for name, value in (("BUCKET", 300), ("SLICE", 4), ("HUB", 2), ("WINDOW", 50), ("SUMMARY", 64), ("FREQUENT", 40)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard.frequent, "__defaults__", (3,))
    assert odd.ordered(jaccard.join(df).collect()) == want


def test_a_large_group_of_borderline_copies_stays_linear(spark):
    rnd = random.Random(8)
    base = odd.prose(rnd, 130).replace("\n", " ").split(" ")
    data = []
    for i in range(260):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        data.append((i, " ".join(words), "en", "a", 0))
    want = plain(data)
    assert 3 < len({r[2] for r in want}) or len({r[2] for r in want}) == 1
    assert odd.ordered(jaccard.join(odd.frame(spark, data)).collect()) == want


def test_odd_rows(spark):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["_text", "_k0", "_n", "node", "root", "component_id", "_t"])
    found = jaccard.join(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert odd.ordered(found.collect()) == plain(data)


def test_no_rows_no_words(spark):
    assert jaccard.join(odd.frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (2, " ", None, None, None)]
    assert odd.ordered(jaccard.join(odd.frame(spark, rows)).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    with pytest.raises(ValueError):
        jaccard.groups(odd.frame(spark, rows), ["doc_id"], similarity=0)


def test_sketches_never_lose_a_pair():
    import numpy as np

    rnd = np.random.default_rng(2)
    for n in (1, 5, 300, 700, 5000):
        a = rnd.integers(0, 2**63, n, dtype=np.uint64)
        for cut in (0, n // 10, n // 3):
            b = np.concatenate([a[cut:], rnd.integers(0, 2**63, cut // 2, dtype=np.uint64)])
            if len(b):
                x, y = jaccard._sketch(a), jaccard._sketch(b)
                words = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (x, y))
                assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
