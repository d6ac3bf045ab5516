import math
import re
from collections import Counter

import odd
import pytest

from graphlog.llm import lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(data, corpus=None, alpha=0.4):
    """Without a corpus each row is scored under all the others."""
    texts = [WORD.findall(r[1] or "") for r in (corpus if corpus is not None else data)]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    out, backed = [], 0
    for r in data:
        words, s = WORD.findall(r[1] or ""), 0.0
        own1, own2, left = Counter(), Counter(), sum(one.values())
        if corpus is None:
            own1, own2, left = Counter(words), Counter(zip(words, words[1:], strict=False)), left - len(words)
        left = max(1, left)
        if words:
            s = math.log(max(1, one[words[0]] - own1[words[0]]) / left)
        for p in zip(words, words[1:], strict=False):
            seen = two[p] - own2[p]
            backed += not seen
            s += math.log(seen / (one[p[0]] - own1[p[0]])) if seen else math.log(alpha * max(1, one[p[1]] - own1[p[1]]) / left)
        out.append((r[0], len(words), s))
    return out, backed


def same(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], round(r[2], 3))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("frequent, size", [(2048, 6 << 20), (3, 2000), (0, 500)])
def test_scores_equal_a_plain_version(spark, monkeypatch, frequent, size):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SLICE_BYTES", size)
    monkeypatch.setattr(lm, "SENT", 50)
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["id", "n_words", "log_score"])
    want, backed = plain(data)
    assert backed > 100  # bigrams found in one text only back off
    same(lm.score(df).select("doc_id", "n_words", "log_score").collect(), want)


def test_the_registered_query_leaves_each_text_out(spark, tmp_path):
    data = odd.rows(3)
    odd.frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    want, backed = plain(data)
    assert backed > 100
    same(queries.op3(spark, str(tmp_path)).collect(), want)


def test_a_copy_vouches_for_a_text_and_a_lone_text_backs_off(spark):
    data = [(1, "p q r s", "en", "a", 7), (2, "p q r s", "en", "a", 7), (3, "t u t u", "en", "a", 7)]
    got = {r[0]: r[2] for r in lm.score(odd.frame(spark, data)).collect()}
    # one other copy: C(p) = 1 of eight other words, then three bigrams always seen
    assert abs(got[1] - math.log(1 / 8)) < 1e-9 and got[1] == got[2]
    assert abs(got[3] - (4 * math.log(1 / 8) + 3 * math.log(0.4))) < 1e-9
    alone = lm.score(odd.frame(spark, data[2:])).collect()
    assert abs(alone[0][2] - 3 * math.log(0.4)) < 1e-9


@pytest.mark.parametrize("frequent", [2048, 5, 0])
def test_other_texts_back_off(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SLICE_BYTES", 1500)
    data, other = odd.rows(1), odd.rows(2)
    mixed = [(r[0], (r[1] or "")[:300] + " unheard of " + (s[1] or "")[:300], *r[2:]) for r, s in zip(data, other, strict=True)]
    got = lm.score(odd.frame(spark, mixed), odd.frame(spark, data)).collect()
    same(got, plain(mixed, data)[0])


def test_empty_tables(spark):
    assert lm.score(odd.frame(spark, [])).count() == 0
    got = lm.score(odd.frame(spark, [(1, "a b", "en", "a", 3), (2, None, None, None, None)]), odd.frame(spark, [])).collect()
    same(got, plain([(1, "a b"), (2, None)], [])[0])
