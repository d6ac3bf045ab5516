"""Token counts under a unigram vocabulary, by dynamic programming on a shared trie.

The distinct pre-tokens a task meets go into one trie. A node stands for a
prefix and keeps the best score of a segmentation of that prefix together with
its number of tokens, worked out once from the node above when the node is
made; the node where a pre-token ends so holds its count. Words that share a
prefix share all its scores, and no word is segmented twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphlog.llm.common import col, once, pieces, tidy

NODES_KEPT = 500_000
WORDS_KEPT = 500_000
LONG_WORD = 64


@dataclass(frozen=True)
class Unigrams:
    """cost of each piece in thousandths of a nat, the lowest sum wins; a character no piece holds costs ``byte`` per UTF-8 byte."""

    costs: dict[str, int]
    byte: int


def read_pieces(path: str) -> Unigrams:
    """The pieces of a SentencePiece model with probabilities by Zipf's law over their order.

    The model's own order is by merge rank, which is no probability; the
    p of the piece at place r (from 1) is 1 / (r * H), H the harmonic sum.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / r for r in range(1, len(names) + 1))
    costs = {n: round(1000 * math.log(r * total)) for r, n in enumerate(names, 1)}
    return Unigrams(costs, max(costs.values()) + 1000)


class Trie:
    """Prefixes seen so far, each with its best cost and count; forgotten together when there are too many.

    A node also keeps its open starts: where a piece may begin that reaches
    past this prefix, with the best cost and count up to there. Only those are
    tried when a node is made below it.
    """

    def __init__(self, model: Unigrams):
        self.model = model
        #: prefix of a piece -> the piece's cost, or -1 where no piece ends
        self.known = {name[:n]: -1 for name in model.costs for n in range(1, len(name))} | model.costs
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[str, tuple[int, int, tuple]] = {"": (0, 0, ())}

    def count_of(self, word: str) -> int:
        """Tokens of the best segmentation: the count kept at the node where the word ends."""
        size, nodes = len(word), self.nodes
        if size > LONG_WORD:  # a long word's own prefixes are not kept
            node = nodes[""]
            for end in range(1, size + 1):
                node = self._below(word, end, node)
            return node[1]
        if len(nodes) > NODES_KEPT:
            self.clear()
            nodes = self.nodes
        end, node = size, nodes.get(word)
        while node is None:  # the longest prefix that is there
            end -= 1
            node = nodes.get(word[:end])
        while end < size:
            end += 1
            node = nodes[word[:end]] = self._below(word, end, node)
        return node[1]

    def _below(self, word: str, end: int, node: tuple[int, int, tuple]) -> tuple[int, int, tuple]:
        """The node of word[:end], from that of word[:end - 1]; fewer tokens win a tie."""
        cost, count, starts = node
        known = self.known
        low, few, still = 1 << 60, 0, []
        for start in (*starts, (end - 1, cost, count)):
            piece = known.get(word[start[0]:end])
            if piece is not None:
                still.append(start)
                if piece >= 0:
                    c, n = start[1] + piece, start[2] + 1
                    if c < low or (c == low and n < few):
                        low, few = c, n
        letter = word[end - 1]
        if letter not in self.model.costs:
            size = len(letter.encode("utf-8", "surrogatepass"))
            c, n = cost + size * self.model.byte, count + size
            if c < low or (c == low and n < few):
                low, few = c, n
        return low, few, tuple(still)


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(r"[^\x20\x09-\x0D]+").findall
        name, model = shared.value

        class Words(dict):
            before: dict[str, int] = {}

            def __missing__(self, word: str) -> int:
                n = self.before.get(word)
                if n is None:
                    n = trie.count_of("▁" + word)
                if len(word) <= LONG_WORD:
                    if len(self) >= WORDS_KEPT:
                        self.before = dict(self)
                        self.clear()
                    self[word] = n
                return n

        trie = once(("unigram", name, "trie"), lambda: Trie(model))
        of = once(("unigram", name, "words"), Words).__getitem__
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            words, tokens = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = find(text or "")
                words.append(len(found))
                tokens.append(sum(map(of, found)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names[:-1], "_words", "_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", n_words: str = "n_words", n_tokens: str = "n_tokens") -> DataFrame:
    """The columns ``keep``, the number of pre-tokens and of tokens of each whole text.

    A pre-token is a word after a word mark (U+2581). Null and empty texts
    count zero. Nothing is shuffled; each worker has its own trie.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((path, read_pieces(path)))
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[col(c).alias(n) for c, n in zip(keep, names, strict=True)], col(text).cast("string").alias("_text"))
    schema: StructType = source.select(*names).schema.add("_words", "long").add("_tokens", "long")
    made = source.mapInArrow(tidy(_counter(shared)), schema)
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_words").alias(n_words), F.col("_tokens").alias(n_tokens))
