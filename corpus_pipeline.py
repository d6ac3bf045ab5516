"""From raw documents to token ids: five operators, one after the other.

Each stage takes all that the one before it kept and returns the columns of
``documents``; the last adds the encoding. ``run`` writes each stage to the
shared folder and reads it back, so that a lost executor costs one stage at
most and nothing is worked out twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.llm import bpe, lines, mix, rules, simhash
from graphlog.storage import materialise

#: The last stages have no SQL form; the whole is tested against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their language and source."""
    measured = materialise(rules.measure(docs, docs.columns, out="_stats"))
    limits = materialise(rules.fences(rules.sketches(measured, stats="_stats")))
    judged = rules.judge(measured, limits, stats="_stats")
    return judged.filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that different texts of their source repeat; n_chars follows. No source (null) is a site too."""
    sited = docs.withColumn("_from", F.coalesce(F.concat(F.lit("="), "source"), F.lit("none")))
    kept = lines.drop_boilerplate(sited, "_from", "text", copies=False).drop("_from")
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id.

    SimHash links texts at three bits or fewer, as in op9; what it links is near
    copies if 0.8 or more of the shingles of five words are shared. An exact
    join adds the pairs of that kind that 64-bit fingerprints miss.
    """
    return simhash.deduplicate(docs, words=5, similarity=0.8, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: each document as often as the mix takes it."""
    return mix.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its token ids and their digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, ["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
