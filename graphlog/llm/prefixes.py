"""A prefix trie of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from the head of its base, another conversation, and
the rest of its own turns. No rebuilt text is ever made: a sequence of turns
has a polynomial fingerprint in three lanes modulo 2**31 - 1, and the
fingerprint of a concatenation follows from those of its parts and the length
of the first. So each stored turn is hashed once, each conversation gets the
running fingerprints of its own turns once, and the fingerprint of every
rebuilt prefix is a sum of a head's fingerprint and a shifted difference of
the conversation's own. Rows carry references to stored turns.

A trie node is a depth and a fingerprint. Nodes are verified: all members must
name one parent and one last turn; where the references differ, the turns they
name are compared themselves. By induction over the depth members then agree
throughout. Should a fingerprint ever collide, everything is done again with
other bases.

Sums over subtrees need no walk: every node is counted at its smallest member,
which goes through all the nodes above it, so that running sums from the end
of each conversation, added up per node, are the sums over its subtree.
Running sums and positions go through ``runs``, which cuts large groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlog.llm.common import WORD, col, tidy
from graphlog.model import CHUNK_ROWS
from graphlog.operators.runs import numbered, running
from graphlog.storage import materialise

PRIME = 2**31 - 1
HEAD = 4  # heads are shorter than this
GROUP = 20  # conversations of one base
CHUNK = CHUNK_ROWS  # turns of a conversation summed in one task
NODE = ["depth", "_f0", "_f1", "_f2"]


def bases(attempt: int = 0) -> list[int]:
    """The three bases of an attempt, of high order modulo the prime."""
    return [pow(7, 2 * (1_000_003 * (3 * attempt + k + 1)) + 1, PRIME) for k in range(3)]


def _power(exponent: Column, base: int) -> Column:
    out = F.lit(1).cast("long")
    for k in range(31):
        bit = exponent.bitwiseAND(F.lit(1 << k).cast("long")) != 0
        out = out * F.when(bit, F.lit(pow(base, 1 << k, PRIME))).otherwise(F.lit(1)).cast("long") % F.lit(PRIME)
    return out


def _mod(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME).cast("long"))


def stored(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", attempt: int = 0) -> DataFrame:
    """(conv, turn, hash, words, _x0.._x2, pos): the stored turns without their texts, numbered from 0 per conversation."""
    said = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text)]
    lanes = [_mod(F.xxhash64(F.lit(3 * attempt + k), *said)).alias(f"_x{k}") for k in range(3)]
    slim = turns.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"), F.xxhash64(F.lit(-1 - attempt), *said).alias("hash"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"), *lanes,
    )
    return numbered(slim, "conv", ["turn", "hash"], "_no").withColumn("pos", F.col("_no") - 1).drop("_no")


def prefixes(rows: DataFrame, group: int = GROUP, head: int = HEAD, attempt: int = 0) -> DataFrame:
    """A row per conversation and prefix of it as rebuilt, from the empty one on.

    (conv, depth, _f0.., _p0.., ref, words, ends, rest): the prefix's and its
    parent's fingerprints, the stored turn it ends with as (conv, turn, hash),
    that turn's words, whether it is the whole, and how many turns follow.
    """
    base_of = bases(attempt)
    rows = materialise(rows)
    convs = materialise(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    terms = [_mod(F.col(f"_x{k}") * _power(F.col("pos"), b)).alias(f"_t{k}") for k, b in enumerate(base_of)]
    ref = F.struct("conv", "turn", "hash").alias("ref")
    termed = rows.select("conv", "pos", "words", ref, *terms)
    large = convs.filter(F.col("n") > CHUNK).select("conv")
    summed = running(termed, ["conv"], "pos", {f"_s{k}": ("sum", F.col(f"_t{k}")) for k in range(3)}, chunk=CHUNK, large=large)
    own = materialise(summed)

    # the first turns of a conversation, as the head of others and as what a conversation leaves out of its own
    short = own.filter(F.col("pos") < head - 1)
    item = F.struct("pos", "ref", "words", *[_mod(F.col(f"_s{k}")).alias(f"f{k}") for k in range(3)])
    heads = short.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("head"))  # at most head - 1 each
    length = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(head)).cast("int")
    known = convs.withColumns({"h": length, "base": F.col("conv") - F.col("conv") % F.lit(group)}).join(heads, "conv", "left")
    lent = heads.select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    planned = known.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    planned = planned.withColumns({"hb": F.size("lent"), "total": F.size("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    plan = materialise(planned)

    none = [F.lit(0).cast("long")] * 3
    empty = plan.select("conv", F.lit(0).cast("long").alias("depth"), *[z.alias(f"_{c}{k}") for c in "fp" for k, z in enumerate(none)],
                        F.lit(None).cast(own.schema["ref"].dataType).alias("ref"), F.lit(0).cast("long").alias("words"), "total")
    at = F.transform("lent", lambda x: F.struct(x.alias("own"), F.when(x["pos"] > 0, F.try_element_at("lent", x["pos"].cast("int"))).alias("up")))
    led = plan.select("conv", "total", F.explode(at).alias("x")).select(
        "conv", (F.col("x.own.pos") + 1).alias("depth"), *[F.col(f"x.own.f{k}").alias(f"_f{k}") for k in range(3)],
        *[F.coalesce(F.col(f"x.up.f{k}"), F.lit(0)).alias(f"_p{k}") for k in range(3)], F.col("x.own.ref").alias("ref"), F.col("x.own.words").alias("words"), "total",
    )
    # head + (own up to here - own left out) * base ** (hb - h); the last factor's exponent is at most 0
    back = F.col("h") - F.col("hb")
    shift = [F.element_at(F.array(*[F.lit(pow(b, -s, PRIME)).cast("long") for s in range(head)]), back + 1) for b in base_of]
    start = [F.coalesce(F.try_element_at("lent", F.when(F.col("hb") > 0, F.col("hb")))[f"f{k}"], F.lit(0)) for k in range(3)]
    left = [F.coalesce(F.try_element_at("head", F.when(F.col("h") > 0, F.col("h")))[f"f{k}"], F.lit(0)) for k in range(3)]
    joint = plan.filter(F.col("n") > F.col("h")).select(
        "conv", "h", "hb", "total", *[s.alias(f"_by{k}") for k, s in enumerate(shift)], *[_mod(a - _mod(b * s)).alias(f"_at{k}") for k, (a, b, s) in enumerate(zip(start, left, shift, strict=True))],
    )

    def moved(k: int, value: Column) -> Column:
        return _mod(F.col(f"_at{k}") + _mod(_mod(value) * F.col(f"_by{k}")))

    rest = own.join(joint, "conv").filter(F.col("pos") >= F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("hb") + 1).cast("long").alias("depth"), *[moved(k, F.col(f"_s{k}")).alias(f"_f{k}") for k in range(3)],
        *[moved(k, F.col(f"_s{k}") - F.col(f"_t{k}")).alias(f"_p{k}") for k in range(3)], "ref", "words", "total",
    )
    whole = empty.unionByName(led).unionByName(rest)
    return whole.withColumns({"ends": F.col("depth") == F.col("total"), "rest": (F.col("total") - F.col("depth")).cast("long")}).drop("total")


def unlike(made: DataFrame, found: DataFrame, turns: DataFrame, conv: str, turn: str, role: str, text: str, attempt: int) -> bool:
    """Whether any node's members differ: in their parents, or in the stored turns they end with."""
    if not found.filter(~F.col("_one_parent")).isEmpty():
        return True
    several = found.filter(~F.col("_one_ref")).select(*NODE)
    if several.isEmpty():
        return False
    named = made.join(several, NODE).select(*NODE, "ref.*").distinct()
    said = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text)]
    texts = turns.select(col(conv).cast("long").alias("conv"), col(turn).alias("turn"), F.xxhash64(F.lit(-1 - attempt), *said).alias("hash"), F.struct(*said).alias("said"))
    met = named.join(texts, (named["conv"] == texts["conv"]) & named["turn"].eqNullSafe(texts["turn"]) & (named["hash"] == texts["hash"]))
    kept = met.groupBy(*NODE).agg((F.min("said") == F.max("said")).alias("same"))
    return not kept.filter(~F.col("same")).isEmpty()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (node, conv) -> the digest of each node's list, one number at a time."""
    import hashlib

    key, digest, done = None, None, []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(len(NODE))]
        made = pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], names=[*NODE, "ends_sha256"])
        done.clear()
        return made

    for batch in batches:
        *nodes, convs = (batch.column(n).to_pylist() for n in [*NODE, "conv"])
        for here, c in zip(zip(*nodes, strict=True), convs, strict=True):
            if here == key:
                digest.update(f",{c}".encode())
                continue
            if digest:
                done.append((key, digest.hexdigest()))
            key, digest = here, hashlib.sha256(str(c).encode())
        if len(done) > 1 << 14:
            yield flush()
    if digest:
        done.append((key, digest.hexdigest()))
    yield flush()


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP,
         head: int = HEAD, attempts: int = 4) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first crc32(c) % ``head`` turns of
    conversation c - c % ``group`` and its own turns after as many. Turns are
    in order of their number, null first; equal numbers in order of a hash of
    role and text, so that the result does not depend on the order of rows. A
    null role or text is empty; a repeated row is a turn of its own; rows of no
    conversation (null) take no part. A conversation whose base is absent
    has no head, and one of no more turns than its head leaves out ends there.
    An empty table has no nodes. Other columns are not read. Conversations
    that end at one node are hashed as one sorted stream, in constant memory.
    """
    for attempt in range(attempts):
        made = materialise(prefixes(stored(turns, conv, turn, role, text, attempt), group, head, attempt))
        parent = F.struct("_p0", "_p1", "_p2")
        merged = made.groupBy(*NODE).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("_ends"), F.max("words").alias("_words"),
            F.min(parent).alias("_parent"), (F.min(parent) == F.max(parent)).alias("_one_parent"), F.min("ref").eqNullSafe(F.max("ref")).alias("_one_ref"),
        )
        found = materialise(merged)
        if not unlike(made, found, turns, conv, turn, role, text, attempt):
            break
    else:
        raise ValueError(f"fingerprints collided {attempts} times")

    lead = F.col("conv") == F.col("conv_id")
    saved = F.when(lead, (F.col("n_convs") - 1) * F.col("_words")).otherwise(0)
    leaf = F.when(lead & (F.col("_ends") == F.col("n_convs")), 1).otherwise(0)
    counted = made.select(*NODE, "conv", "rest").join(found.select(*NODE, "conv_id", "n_convs", "_ends", "_words"), NODE)
    counted = counted.select(*NODE, "conv", "rest", saved.alias("_saved"), leaf.cast("long").alias("_leaf"))
    large = made.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK).select("conv")
    summed = running(counted, ["conv"], "rest", {"_below": ("sum", F.col("_saved")), "_leaves": ("sum", F.col("_leaf"))}, chunk=CHUNK, large=large)
    totals = summed.groupBy(*NODE).agg(F.sum("_below").alias("saved_tokens"), F.sum("_leaves").alias("n_leaves"))

    up = [(F.col("depth") - 1).alias("depth"), *[F.col(f"_parent._p{k}").alias(f"_f{k}") for k in range(3)]]
    children = found.filter("depth > 0").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    over = found.select(*[F.col(c).alias(f"_up_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    is_up = (F.col("_up_depth") == F.col("depth") - 1) & (F.col("_up__f0") == F.col("_parent._p0")) & (F.col("_up__f1") == F.col("_parent._p1")) & (F.col("_up__f2") == F.col("_parent._p2"))
    last = made.filter("ends").select(*NODE, "conv").repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    ends = last.mapInArrow(tidy(_digests), made.select(*NODE, F.lit("").alias("ends_sha256")).schema)
    nodes = found.join(totals, NODE).join(children, NODE, "left").join(ends, NODE, "left").join(over, is_up, "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: The same nodes in DuckDB, from whole lists of turns; crc32 from its definition.
SQL = r"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT c, list(said ORDER BY pos) AS own FROM t GROUP BY c),
    h AS (SELECT c, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) % 4 AS h FROM o),
    r AS (SELECT h.c, list_concat(coalesce(list_slice(b.own, 1, h.h), []), coalesce(list_slice(h.own, h.h + 1, len(h.own)), [])) AS seq FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
    p AS (SELECT c, d AS depth, list_slice(seq, 1, d) AS pre, list_slice(seq, 1, d - 1) AS par, d = len(seq) AS ends,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(seq[d].text, '[^\x20\x09-\x0D]+')) END AS words FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
    n AS (SELECT depth, pre, min(c) AS conv_id, count(*) AS n_convs, any_value(par) AS par, any_value(words) AS words, count(*) FILTER (ends) AS n_ends,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, pre),
    k AS (SELECT depth - 1 AS depth, par, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, par),
    s AS (SELECT p.depth, p.pre, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (n.n_ends = n.n_convs) AS leaves
        FROM p JOIN p q ON q.c = p.c AND q.depth >= p.depth JOIN n ON n.depth = q.depth AND n.pre = q.pre AND n.conv_id = q.c GROUP BY p.depth, p.pre)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.pre = n.par LEFT JOIN k ON k.depth = n.depth AND k.par = n.pre LEFT JOIN s ON s.depth = n.depth AND s.pre = n.pre"""
