import random
import re

import odd
import public_tokenizers
import pytest

from graphlog.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(model, word):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + model.costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in model.costs]
        if word[end - 1] not in model.costs:
            n = len(word[end - 1].encode())
            ways.append((best[end - 1][0] + n * model.byte, best[end - 1][1] + n))
        best.append(min(ways))
    return best[-1][1]


@pytest.fixture(scope="module")
def model():
    return unigram.read_pieces(PATH)


@pytest.mark.parametrize("nodes", [250_000, 50])
def test_shared_prefixes_give_the_best_segmentation(model, monkeypatch, nodes):
    monkeypatch.setattr(unigram, "NODES_KEPT", nodes)
    trie, rnd = unigram.Trie(model), random.Random(3)
    letters = ["the cat in".replace(" ", ""), "aeioustrn", "éü日本🙂ab", "0123456789"]
    for _ in range(600):
        word = "▁" + "".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.randint(0, 40)))
        assert trie.count_of(word) == plain(model, word)
    long = "▁" + "abcé" * 200
    assert trie.count_of(long) == plain(model, long)


def test_documents(spark, model):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["_text", "_words", "n_tokens"])
    found = unigram.count_tokens(df, PATH, ["doc_id", "_text"])
    assert found.columns == ["doc_id", "_text", "n_words", "n_tokens"]
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    memo = {}
    want = [(i, len(ws), sum(memo.setdefault(w, plain(model, "▁" + w) if w not in memo else 0) for w in ws)) for i, ws in words]
    assert odd.ordered(found.select("doc_id", "n_words", "n_tokens").collect()) == odd.ordered(want)
    assert unigram.count_tokens(odd.frame(spark, []), PATH, ["doc_id"]).count() == 0
