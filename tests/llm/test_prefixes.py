import hashlib
import random
import re
import zlib

import odd
import pytest

from graphlog.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes from whole rebuilt lists of turns."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below),
            sum(not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in below) for m in below),
            sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return odd.ordered(out)


def data():
    rnd = random.Random(4)
    rows = []
    said = [("system", "be kind and brief"), ("user", "hello there"), ("user", None), (None, "what now"), ("assistant", ""), ("assistant", "  \t"), ("user", "Grüße 日本語")]
    for c in [*range(-25, 45), 60, 67, 99, 100, 103, 104, 10**12, 10**12 + 1]:
        for turn in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            role, text = rnd.choice(said)
            rows.append((c, turn if turn or c % 3 else None, role, text))
    rows += [(3, 50, "user", f"turn {i}") for i in (1,)] + [(3, 50, "user", "turn 1")] * 2  # repeated rows
    rows += [(40, i, "user", f"long {i % 7}") for i in range(10, 300)] + [(41, 900, "user", "x " * 5000)]
    return [*rows, (None, 1, "user", "of no conversation"), (None, None, None, None)]


def test_equals_plain_lists_with_long_conversations_cut(spark, monkeypatch):
    rows = data()
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for chunk in (prefixes.CHUNK, 16):
        monkeypatch.setattr(prefixes, "CHUNK", chunk)
        found = prefixes.trie(odd.clashing(df, ["depth", "pos", "hash", "conv", "words", "_f0", "ref"]))
        assert found.columns == COLUMNS
        assert odd.ordered(found.collect()) == want


def test_sql_says_the_same(spark):
    import duckdb
    import pyarrow as pa

    rows = data()
    con = duckdb.connect()
    kinds = [("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())]
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)}))
    cursor = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixes.SQL})")
    assert odd.ordered(cursor.fetchall()) == plain(rows)


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PRIME", 3)
    df = spark.createDataFrame(data(), SCHEMA)
    with pytest.raises(ValueError, match="collided"):
        prefixes.trie(df, attempts=2)


def test_empty_and_turnless(spark):
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "one") for c in range(1, 20)]  # the base, 0, is absent: those of a head end at the root
    got = odd.ordered(prefixes.trie(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows) and len(got) == 2
