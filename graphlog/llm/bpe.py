"""Byte-level BPE by backtracking over longest matches.

The tokens of a vocabulary, read as Latin-1 so that one character is one byte,
form an Aho-Corasick automaton. A piece of text is encoded from left to right:
take the longest token that starts here; if merging would never leave the
token before it and this one side by side, try the next shorter token; if none
fits, give up the token before, note that its end is a dead end, and try again
from there. Whether two tokens may stand side by side is worked out once per
pair by undoing their merges, and remembered. Every position is given up at
most once, so a piece of n bytes costs O(n), and the result is the one that
merging by rank gives.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType

from graphlog.llm.common import col, once, pieces, tidy

PIECES_KEPT = 150_000
PAIRS_KEPT = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64, a space, the id, line by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """A rank table, ready to encode pieces and decode ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.reach = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # id -> id of its longest proper prefix that is a token
        for token, i in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in ranks:
                    self.shorter[i] = ranks[token[:n]]
                    break
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # id -> the pair whose merge makes it
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            left = self.shorter.get(i)
            while left is not None:
                right = ranks.get(token[len(self.bytes_of[left]):])
                if right is not None and left < i and right < i and self._fit(left, right):
                    self.merged[left, right] = i
                    self.halves[i] = left, right
                    break
                left = self.shorter.get(left)
        self.known: dict[tuple[int, int], bool] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens side by side.

        Undo the younger of the two merges that face each other and look if the
        tokens at the seam would have merged across it at an earlier rank.
        """
        merged, halves = self.merged, self.halves
        bound = 1 << 62
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:  # of two merges at one rank the left one comes first
                bound, right = right + 1, b[0]

    def fit(self, left: int, right: int) -> bool:
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) >= PAIRS_KEPT:
                self.known.clear()
            known = self.known[left, right] = self._fit(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. Bytes that are no token of their own raise ``KeyError``."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        text, end = piece.decode("latin-1"), len(piece)
        shorter, bytes_of, known = self.shorter, self.bytes_of, self.known
        # longest matches, each from where the one before ends, as far as neighbours fit
        greedy = [i for _, i in self.automaton.iter_long(text)]
        last, count = -1, 0
        for token in greedy:
            if last >= 0:
                fits = known.get((last, token))
                if not (self.fit(last, token) if fits is None else fits):
                    break
            last = token
            count += 1
        ids = greedy[:count]
        at = sum(map(len, map(bytes_of.__getitem__, ids)))
        if at == end:
            return ids
        if count == len(greedy):
            raise KeyError(piece)  # a gap between matches
        dead = bytearray(end + 1)
        token: int | None = greedy[count]
        while True:
            last = ids[-1] if ids else -1
            while token is not None:
                stop = at + len(bytes_of[token])
                if not dead[stop] and (last < 0 or self.fit(last, token)):
                    break
                token = shorter.get(token)
            if token is not None:
                ids.append(token)
                at = stop
                if at == end:
                    return ids
                token = self._longest(text, at)
            else:
                if not ids:
                    raise KeyError(piece)
                dead[at] = 1
                back = ids.pop()
                at -= len(bytes_of[back])
                token = shorter.get(back)

    def _longest(self, text: str, at: int) -> int | None:
        """The longest token that starts at ``at``."""
        for stop, i in self.automaton.iter_long(text, at, min(len(text), at + self.reach)):
            return i if stop - len(self.bytes_of[i]) + 1 == at else None
        return None


def _encoder(shared, pattern: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, name = shared.value

        class Pieces(dict):
            """piece -> its ids, in two generations of a bounded size."""

            before: dict[str, tuple[int, ...]] = {}

            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = self.before.get(piece)
                if ids is None:
                    ids = tuple(vocabulary.encode(piece.encode()))
                if len(piece) < 64:
                    if len(self) >= PIECES_KEPT:
                        self.before = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        vocabulary = once(("bpe", name, "vocabulary"), lambda: Vocabulary(ranks))
        found = regex.compile(pattern).findall
        ids_of = once(("bpe", name, "pieces"), Pieces).__getitem__
        for batch in batches:
            for part in pieces(batch, "_in"):
                flat = array("i")
                stops = [0]
                for text in part.column(part.num_columns - 1).to_pylist():
                    flat.extend(chain.from_iterable(map(ids_of, found(text or ""))))
                    stops.append(len(flat))
                offsets, values = pa.array(stops, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())
                made = [pa.ListArray.from_arrays(offsets, values)]
                if decoded:
                    tokens = list(map(vocabulary.bytes_of.__getitem__, flat))
                    made.append(pa.array([b"".join(tokens[a:b]) for a, b in pairwise(stops)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "_ids", "_bytes"][:part.num_columns + decoded])

    return run


def _running(sizes) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, name = shared.value
        table = once(("bpe", name, "bytes"), lambda: {i: t for t, i in ranks.items()})
        for batch in batches:
            for part in pieces(batch, "_in", 500_000):
                column = part.column(part.num_columns - 1)
                tokens = list(map(table.__getitem__, column.flatten().to_numpy().tolist()))
                stops = list(_running(pc.fill_null(pc.list_value_length(column), 0).to_pylist()))
                rows = [b"".join(tokens[a:b]) if known else None for a, b, known in zip([0, *stops], stops, column.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.binary())], names=[*part.schema.names[:-1], "_bytes"])

    return run


def _ship(spark: SparkSession, path: str):
    """The rank table as a broadcast; its size is the vocabulary's, not the data's."""
    return spark.sparkContext.broadcast((read_ranks(path), path))


def _with(df: DataFrame, column: str, cast: str, run, made: dict[str, tuple[str, DataType]]) -> DataFrame:
    """``made``: name in the batches -> (name in the result, type)."""
    rest = [c for c in df.columns if c.lower() not in {out.lower() for out, _ in made.values()}]
    names = [f"_c{i}" for i in range(len(rest))]
    source = df.select(*[col(c).alias(n) for c, n in zip(rest, names, strict=True)], col(column).cast(cast).alias("_in"))
    schema = source.drop("_in").schema
    for name, (_, kind) in made.items():
        schema = schema.add(name, kind)
    done = source.mapInArrow(tidy(run), schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, rest, strict=True)], *[F.col(n).alias(out) for n, (out, _) in made.items()])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of ints.

    ``pattern`` cuts the text into pieces that are encoded separately; no
    special tokens. A null or empty text has no ids. A column already called
    ``out`` is replaced. ``decoded`` names a column for the bytes the ids
    stand for, read back in the same pass. Rows stay where they are: nothing
    is shuffled.
    """
    made: dict[str, tuple[str, DataType]] = {"_ids": (out, ArrayType(IntegerType()))}
    if decoded:
        made["_bytes"] = decoded, BinaryType()
    return _with(df, text, "string", _encoder(_ship(df.sparkSession, path), pattern, bool(decoded)), made)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null ids give null."""
    return _with(df, ids, "array<int>", _decoder(_ship(df.sparkSession, path)), {"_bytes": (out, BinaryType())})


def digest(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, and SHA-256 of the ids (decimal, joined by a space) and of the bytes decoded from them."""
    slim = df.select(*[col(c) for c in keep], col(text).alias("_ids_"))
    coded = encode(slim, path, pattern, "_ids_", "_ids_", "_bytes_")
    return coded.select(
        *[col(c) for c in keep],
        F.size("_ids_").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("_ids_", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("_bytes_", 256).alias("decoded_sha256"),
    )
