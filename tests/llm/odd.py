"""Small tables with everything a table may hold: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, words: int, letters: str = "abdeiklmnoprstu") -> str:
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(words)]
    return " ".join(w + ("\n" if rnd.random() < 0.08 else "") for w in made).replace("\n ", "\n")


def rows(seed: int = 1, size: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(12, 160)) for _ in range(size // 2)]
    out = []
    for i in range(size):
        text = rnd.choice(base)
        if i % 3 == 0:
            words = text.split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", "c", None]), len(text)))
    long = prose(rnd, 6000) + " " + base[0]
    out += [
        (size, None, "en", "a", None), (size + 1, "", None, "b", 0), (size + 2, " \n\t ", "en", None, 4), (size + 3, "one", "en", "b", 3),
        (size + 4, "Grüße 日本語 🙂 \u0085 \x1c x", "de", "c", 20), (size + 5, long, "en", "a", len(long)), (size + 6, long, "en", "b", len(long)),
        (None, base[1], None, None, None), (None, base[1], None, None, None), (3, out[3][1], out[3][2], out[3][3], out[3][4]), (4, "another text under an id", "en", "a", 1),
        (size + 7, "x" * 3000, "en", "zzz", 3000), (size + 8, "ab " * 700, "en", "a", 2100),
    ]
    return out


def frame(spark, data: list[tuple]):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def clashing(df, names: list[str]):
    """``df`` with more columns, of the names an operator might use itself."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit(n))
    return df


def duck(data: list[tuple]):
    import duckdb
    import pyarrow as pa

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    documents = pa.table({n: pa.array([r[i] for r in data], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    con = duckdb.connect()
    con.register("documents", documents)
    return con


def ordered(found) -> list[tuple]:
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))
