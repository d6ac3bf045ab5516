import random

import odd
import public_tokenizers
import pytest
import regex
import tiktoken

from graphlog.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


def test_pieces_are_merged_as_the_library_merges_them(vocabulary, library):
    rnd = random.Random(5)
    letters = ["ab", "the cat sat", "aeiouth sn", "éüßñ", "   \n\t", "0123", "日本語", " \x85\x1c\x1f🙂", "<|endoftext|>'s't"]
    for _ in range(3000):
        kind = rnd.choice(letters)
        text = "".join(rnd.choice(kind) for _ in range(rnd.randint(1, 60)))
        own = [i for p in regex.findall(public_tokenizers.PATTERN, text) for i in vocabulary.encode(p.encode())]
        assert own == library.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["a" * 20000, "ab" * 9000, "th" * 9000 + "e", "é" * 5000])
def test_long_pieces_take_linear_time_and_come_out_right(vocabulary, library, piece):
    assert vocabulary.encode(piece.encode()) == library._encode_single_piece(piece)


def test_tokens_that_cannot_be_reached_by_merging_are_not_used():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259}
    own = bpe.Vocabulary(ranks)
    assert own.encode(b"xabcd") == [ord("x"), 258]
    assert own.encode(b"xbcd") == [ord("x"), 257, ord("d")]
    assert own.encode(b"") == []
    with pytest.raises(KeyError):
        bpe.Vocabulary({b"a": 0}).encode(b"ab")


def test_documents_round_trip(spark, library):
    data = odd.rows()
    df = odd.clashing(odd.frame(spark, data), ["_in", "_ids", "_bytes", "dotted.name"])
    coded = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert coded.columns == [*df.columns, "ids", "bytes"]
    at_once = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded="bytes")
    found = coded.collect()
    assert odd.ordered(found) == odd.ordered(at_once.collect())
    assert len(found) == len(data)
    for r in found:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
        assert r["dotted.name"] == "dotted.name"


def test_columns_of_the_result_replace_their_namesakes(spark):
    df = odd.clashing(odd.frame(spark, odd.rows()[:5]), ["ids", "n_tokens"])
    assert bpe.encode(df, PATH, public_tokenizers.PATTERN).schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.digest(df, PATH, public_tokenizers.PATTERN, ["doc_id", "ids"]).columns[:2] == ["doc_id", "ids"]


def test_empty_table_and_null_ids(spark):
    none = odd.frame(spark, [])
    assert bpe.digest(none, PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [257, 258])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in bpe.decode(ids, PATH).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and len(got[3]) == 4
