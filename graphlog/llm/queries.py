"""One registered query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.llm import bitslice, bpe, jaccard, lines, lm, mix, prefixes, repeats, rules, search, shards, simhash, unigram
from graphlog.llm.common import table
from graphlog.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# what of a page is not text, tags that do not end a line, and the host of an address; the SQL has the same
_UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_INLINE = r"(?i)</?(?:a|b|i|em|strong|span|small|u)\b[^>]*>"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


@query(
    "op1_line_dedup",
    f"""WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
        regexp_replace(regexp_replace(regexp_replace(html, '{_UNSEEN}', '', 'g'), '{_INLINE}', '', 'g'), '<[^>]*>', chr(10), 'g') AS text FROM pages),
    l AS (SELECT rid, host, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM p),
    k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS key FROM l),
    c AS (SELECT host, key, count(DISTINCT rid) AS n FROM k WHERE key <> '' AND host IS NOT NULL GROUP BY host, key),
    h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
    b AS (SELECT host, key FROM c JOIN h USING (host) WHERE n * 100 > pages * 5 + 95 * sqrt(pages)),
    m AS (SELECT k.*, b.key IS NOT NULL AS bad FROM k LEFT JOIN b ON k.host = b.host AND k.key = b.key),
    r AS (SELECT rid, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (bad) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text FROM m GROUP BY rid)
    SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, r.text FROM p LEFT JOIN r USING (rid)""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", _UNSEEN, ""), _INLINE, ""), "<[^>]*>", "\n")
    cut = materialise(pages.select("page_id", F.when(host != "", host).alias("host"), text.alias("text")))  # the markup is searched once
    return lines.drop_boilerplate(cut, "host", "text", n_lines="n_lines", n_dropped="n_dropped")


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, ["doc_id"])


@query("op3_lm_scoring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = repeats.remove_repeats(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_quality_rules", rules.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    measured = materialise(rules.measure(table(spark, folder, "documents"), ["doc_id", "lang", "source"]))
    limits = materialise(rules.fences(rules.sketches(measured)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rules.judge(measured, limits).select("doc_id", *[f"stats.{c}" for c in counts], "base_failed", "kept")


@query(
    "op6_bit_sliced_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = bitslice.top_k(vectors.filter("vec_id % 100 = 0"), bitslice.index(vectors))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op7_mix_sources", mix.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return unigram.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


@query("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_sharding", shards.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shards.place(rows, "doc_id", shards.tree(16), shards.tree(17), ["doc_id", "size", "text_crc32"])


@query("op11_ranked_search", search.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_jaccard_join", jaccard.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query("op13_conversation_trie", prefixes.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))
