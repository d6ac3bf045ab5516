import random
import re

import odd
import xxhash
from pyspark.sql import functions as F

from graphlog.llm import simhash


def plain(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def components(prints, distance):
    tree = list(range(len(prints)))

    def find(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                tree[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_groups_equal_all_pairs(spark):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["fingerprint", "_fp", "root", "_text", "_k0"])
    got = odd.ordered(simhash.groups(df).select("doc_id", simhash.hexed(F.col("fingerprint")), "component_id").collect())
    prints = [plain(r[1]) for r in data]
    roots = components(prints, 3)
    low = {}
    for r, root in zip(data, roots, strict=True):
        if r[0] is not None:
            low[root] = min(r[0], low.get(root, r[0]))
    assert got == odd.ordered((r[0], f"{p:016x}", low.get(root)) for r, p, root in zip(data, prints, roots, strict=True))


def test_dense_groups_and_sliced_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(60)}
    prints = sorted(p - 2**64 if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint long")
    found = simhash.links(df, bucket_rows=8)
    assert found.count() < 20 * len(prints)
    tied = {r.node: r.component for r in simhash.components(found).collect()}
    bare = [p & (2**64 - 1) for p in prints]
    roots = components(bare, 3)
    want = {}
    for p, r in zip(prints, roots, strict=True):
        want.setdefault(r, set()).add(p)
    got = {}
    for p in prints:
        got.setdefault(tied.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    found = {r.node: r.component for r in simhash.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1301)} == {1000} and 5000 not in found


def test_near_copies_go_and_unlike_texts_stay(spark):
    rnd = random.Random(9)
    base = [odd.prose(rnd, 220).replace("\n", " ") for _ in range(12)]
    data = [(i, t, "en", "a", 0) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split(" ")
        words[40], words[150] = "other", "words"
        data.append((100 + i, " ".join(words), "en", "b", 0))
        half = t.split(" ")[:80]
        data.append((200 + i, " ".join(half) + " " + odd.prose(rnd, 150).replace("\n", " "), "en", "b", 0))
    df = odd.frame(spark, data + data[:3])
    kept = sorted(r.doc_id for r in simhash.deduplicate(df).collect())
    assert [i for i in kept if i < 100] == list(range(12))
    assert [i for i in kept if i >= 200] == list(range(200, 212))
    assert len([i for i in kept if 100 <= i < 200]) <= 1


def test_odd_rows_are_kept_once_with_their_columns(spark):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["_nid", "_sid", "_txt", "_fp"])
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert len({r.text for r in found}) == len(found)
    assert min(r[0] for r in data if not (r[1] or "").strip()) in {r.doc_id for r in found}
    assert simhash.deduplicate(odd.frame(spark, [])).count() == 0
    assert simhash.groups(odd.frame(spark, [])).count() == 0


def exact_groups(texts, least=0.8):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    tree = list(range(len(sets)))

    def find(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                tree[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_copies_equal_all_pairs_by_jaccard(spark):
    rnd = random.Random(31)
    passage = odd.prose(rnd, 30).replace("\n", " ")
    base = [odd.prose(rnd, rnd.choice([12, 60, 90, 220])).replace("\n", " ") + (" " + passage if i % 3 == 0 else "") for i in range(50)]
    texts = list(base)
    for t in base:  # a run of changed words: similarities on both sides of 0.8
        for share in (0.04, 0.08, 0.1, 0.14):
            words = t.split(" ")
            at = rnd.randrange(len(words) // 2)
            for k in range(max(1, int(share * len(words)))):
                words[at + k] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [passage, passage + " more", "", None, "one"]
    want = exact_groups(texts)
    assert 60 < len(set(want)) < len(texts) - 40
    data = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    kept = sorted(r.doc_id for r in simhash.deduplicate(odd.frame(spark, data)).collect())
    assert kept == sorted(set(want))
