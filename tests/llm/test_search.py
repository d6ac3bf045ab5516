import random

import numpy as np
import odd

from graphlog.llm import search


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain(data, asked):
    con = odd.duck(data)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if asked:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", asked)
    return odd.ordered(con.execute(search.SQL).fetchall())


def asked(data):
    texts = [r[1] for r in data if r[1]]
    return [(i, " ".join(texts[i * 3].split()[:25])) for i in range(12)] + [(50, texts[1]), (50, texts[2]), (51, None), (52, ""), (53, "nowhere to be found"), (0, " ".join(texts[0].split()[:25])), (None, "GRÜSSE one X"), (54, "ab")]


def test_equals_sql_on_odd_rows_at_any_segment_and_block(spark, monkeypatch):
    data = odd.rows()
    query = asked(data)
    want = plain(data, query)
    assert len(want) > 200 and any(r[0] is None for r in want)
    docs = odd.clashing(odd.frame(spark, data), ["_text", "_id", "item_id", "rank", "score", "_row", "_n"])
    for segment, step, block in ((search.SEGMENT, search.STEP, search.ITEM_BYTES), (300, 3, 1500)):
        monkeypatch.setattr(search, "SEGMENT", segment)
        monkeypatch.setattr(search, "STEP", step)
        monkeypatch.setattr(search, "ITEM_BYTES", block)
        found = search.search(docs, odd.clashing(items(spark, query), ["_item", "doc_id", "rank"]))
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert odd.ordered(found.collect()) == want


def test_ties_rank_by_id_and_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 64)
    data = [(i, "same words here", "en", "a", 0) for i in range(200, 0, -1)] + [(500, "x" * 500 + " filler" * 400 + " rareword", "en", "a", 0)]
    query = [(1, "same here"), (2, "rareword")]
    got = odd.ordered(search.search(odd.frame(spark, data), items(spark, query)).collect())
    assert got == plain(data, query)
    assert sorted(r[2] for r in got if r[0] == 1) == list(range(1, 51)) and [r[2] for r in got if r[0] == 2] == [500]


def test_empty_tables_give_no_rows(spark):
    assert search.search(odd.frame(spark, []), items(spark, [(1, "a")])).count() == 0
    assert search.search(odd.frame(spark, odd.rows()), items(spark, [])).count() == 0
    assert search.search(odd.frame(spark, [(1, None, None, None, None), (2, " ", None, None, None)]), items(spark, [(1, "a")])).count() == 0


def test_intervals_find_the_best_of_random_lists(spark):
    rnd = np.random.default_rng(5)
    random.seed(5)
    for size in (1, 7, 400, 3000):
        slots, docs, impacts = [], [], []
        for t in range(12):
            some = np.flatnonzero(rnd.random(size) < 1 / (t + 1))
            slots.append(np.full(len(some), t))
            docs.append(some)
            impacts.append(rnd.integers(1, 6 if t % 2 else 1000, len(some)) * (t + 1))
        slots, docs, impacts = (np.concatenate(x) for x in (slots, docs, impacts))
        made = search.Segment(slots, docs.astype(np.int32), impacts, size, 12)
        for terms in ([0], [3, 5, 7], list(range(12))):
            total = np.zeros(size, np.int64)
            for t in terms:
                np.add.at(total, docs[slots == t], impacts[slots == t])
            order = sorted(np.flatnonzero(total).tolist(), key=lambda d: (-total[d], d))[:10]
            got, scores = made.best(np.array(terms), 10)
            assert got.tolist() == order and scores.tolist() == total[order].tolist()
