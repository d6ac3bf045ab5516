import hashlib
import random
from collections import Counter

import corpus_pipeline
import odd
import public_tokenizers
import tiktoken
from test_lines import plain as cut_lines
from test_simhash import exact_groups

from graphlog.llm import bpe, jaccard, mix, rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def data():
    rnd = random.Random(21)
    rows = []
    for i in range(140):
        text = odd.prose(rnd, rnd.randint(15, 140))
        if i % 9 == 0:
            text = " ".join(w + "%%%" for w in text.split(" "))
        if i % 4 == 0:
            text = "menu of the site\n" + text
        rows.append((i, text, "en", rnd.choice(["a", "a", "b", None]), len(text)))
    for i in range(40):
        words = rows[i][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "other"
        rows.append((200 + i, " ".join(words), "en", "b", 1))
    return rows + [(300, "", "en", "a", 0), (301, None, None, None, None)]


def test_run_equals_a_plain_version(spark, tmp_path):
    rows = data()
    odd.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = {r[0] for r in odd.duck(rows).execute(rules.SQL).fetchall() if r[7]}
    rows = sorted(r for r in rows if r[0] in kept)
    lines = {r[0]: r[1] for r in cut_lines([(*r[:3], r[3] or "of none", r[4]) for r in rows], 5)}
    rows = [(r[0], lines[r[0]], r[2], r[3], r[4]) for r in rows]
    assert any("menu of the site" not in r[1] for r in rows if r[0] % 4 == 0)
    rows = [rows[i] for i in sorted(set(exact_groups([r[1] for r in rows])))]
    assert not {r[0] for r in rows} & set(range(200, 240, 2))
    times = {r[0]: r[4] // r[1] for r in odd.duck(rows).execute(mix.SQL).fetchall() if r[1]}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1])
        row = (r[0], r[3], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
        want[row] = times.get(r[0], 0)
    assert got == +want and sum(got.values()) > 40


def test_stages_take_any_rows_and_return_the_columns(spark, tmp_path):
    for rows in (odd.rows(), []):
        docs = odd.frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame(docs.collect(), odd.SCHEMA)
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()


def test_near_copies_come_through_fingerprints(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    long = [f"w{rnd.randrange(5000)}" for _ in range(2000)]
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(long[:900]), " ".join(long[::-1])]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    told, groups = [], jaccard.groups
    monkeypatch.setattr(jaccard, "groups", lambda *a: told.extend(a[-1].collect()) or groups(*a))
    kept = corpus_pipeline.near_dedup(spark, odd.frame(spark, rows), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]
    assert len(told) == 4 and max(Counter(r.near for r in told).values()) == 2  # 0 and 1 are linked
