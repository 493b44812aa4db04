"""The trie of conversations' common beginnings, by partition refinement.

All conversations start in one class. Each round splits the classes that are still active by their members' next turns and
retires classes of one member: from there on a conversation shares nothing, and the rest of its turns is its own chain.
The first rounds take a turn each, later ones up to STRIDE turns at once, still splitting at every turn, so conversations
with long common beginnings need few rounds. A class is named by the digest of the turns that lead to it, so splitting
needs no numbering, and what a round gives does not depend on the order of work.

Folding back needs no rounds: what a subtree saves is what its members share with smaller members. A member shares with
smaller ones from the root to one depth, so it brings one number, its words up to there; a class sums its members' numbers
and takes off the words above itself. Leaves are counted the same way, by one member each.

Texts are moved in no shuffle; turns are told apart by the SHA-256 of role and text.

Defined results: null roles and texts are empty; rows without a conversation are no turns; turns of equal number are in
order of their digests, repeated rows are repeated turns; remainders of negative ids are negative, as in SQL; without
conversations there are no nodes; other columns of the input are not read. One conversation, class or turn may hold any
share of the rows: such keys are spread, but the digest of one class's ends, which is sequential by its meaning, is read by
one task as rows of up to 4,096 ids, never held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import Scratch, lookup, narrow_batches, null_to_empty, range_sorted, table

#: Turns that a round takes at most.
STRIDE = 64
#: Ids that one row of a class's ends holds: 2^ENDS_BITS.
ENDS_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest() -> Column:
    role, text = null_to_empty("role"), null_to_empty("text")
    return F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)


def turn_store(conversations: DataFrame) -> DataFrame:
    """(turn_sha256, role, text): each distinct turn once; nodes refer to it."""
    rows = conversations.select(turn_digest().alias("turn_sha256"), null_to_empty("role").alias("role"), null_to_empty("text").alias("text"))
    return rows.groupBy("turn_sha256").agg(F.first("role").alias("role"), F.first("text").alias("text"))


def turns_of(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n) and the turns (conv, depth from 1, turn, words). A range sort numbers them, so a long conversation is no single task."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("_turn"), F.unhex(turn_digest()).alias("turn"), F.size(F.regexp_extract_all(null_to_empty("text"), F.lit(WORD), F.lit(0))).cast("long").alias("words")
    )
    placed = scratch.save(range_sorted(scratch, rows, ["conv", "_turn", "turn"]))
    convs = scratch.save(placed.groupBy("conv").agg(F.min("_pos").alias("_start"), F.count("*").alias("n")))
    turns = lookup(placed, convs, "conv", "n").select("conv", (F.col("_pos") - F.col("_start") + 1).alias("depth"), "turn", "words")
    return convs.select("conv", "n"), turns


def rebuilt(scratch: Scratch, conversations: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, length) and turns, each conversation begun with the first turns of its family's first one.

    The number of turns is the CRC-32 of the id, modulo ``heads``; they replace as many turns of its own.
    """
    n_of, turns = turns_of(scratch, conversations)
    turns = scratch.save(turns)
    base = F.col("conv") - F.col("conv") % family
    own = n_of.select("conv", "n", base.alias("base"), F.when(base == F.col("conv"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("head"))
    own = own.join(n_of.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    own = scratch.save(own.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))))
    rest = lookup(turns, own.select("conv", "head", "taken", "n"), "conv", "n").where(F.col("depth") > F.col("head")).select("conv", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "turn", "words")
    first = turns.where((F.col("depth") < heads) & (F.col("conv") % family == 0)).select(F.col("conv").alias("base"), "depth", "turn", "words")
    begun = own.where("taken > 0").join(first, "base").where(F.col("depth") <= F.col("taken")).select("conv", "depth", "turn", "words")
    return own.select("conv", "length"), rest.unionByName(begun)


def _round_of(depth: str) -> Column:
    """Rounds 1 to 4 take a turn each, the next 2, 4, ... and all from the tenth on STRIDE turns."""
    return F.expr(f"CASE WHEN {depth} <= 4 THEN {depth} WHEN {depth} <= 130 THEN 4 + length(bin(({depth} - 5) div 2 + 1)) ELSE 11 + ({depth} - 131) div {STRIDE} END")


def _last_of(k: int) -> int:
    return k if k <= 4 else 4 + 2 * (2 ** (k - 4) - 1) if k <= 10 else 130 + STRIDE * (k - 10)


def _split(active: DataFrame, turns: DataFrame, one: bool) -> DataFrame:
    """(conv, length, parent, class, depth, turn, words, total) of the active members' next turns; total: words down to here."""
    met = active.join(turns, "conv")
    if one:
        return met.select("conv", "length", F.col("class").alias("parent"), F.unhex(F.sha2(F.concat("class", "turn"), 256)).alias("class"), "depth", "turn", "words", (F.col("total") + F.col("words")).alias("total"))
    runs = met.groupBy("conv", "length", "class", "total").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))).alias("t"))  # STRIDE turns at most
    name = "unhex(sha2(concat(class, unhex(array_join(transform(slice(t, 1, {k}), x -> hex(x.turn)), ''))), 256))"
    each = F.expr(
        f"transform(t, (x, i) -> struct(x.depth AS depth, x.turn AS turn, x.words AS words, IF(i = 0, class, {name.format(k='i')}) AS parent, {name.format(k='i + 1')} AS class, "
        "total + aggregate(slice(t, 1, i + 1), 0L, (s, y) -> s + y.words) AS total))"
    )
    return runs.select("conv", "length", F.explode(each).alias("x")).select("conv", "length", "x.parent", "x.class", "x.depth", "x.turn", "x.words", "x.total")


def refine(scratch: Scratch, convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, length, parent, class, depth, turn, words, total) of all classes until they retired, and the classes with their n and smallest member."""
    spark = scratch.spark
    root = F.unhex(F.lit(_NOTHING))
    no = F.lit(None).cast("binary")
    rows = convs.select("conv", "length", no.alias("parent"), root.alias("class"), F.lit(0).cast("long").alias("depth"), no.alias("turn"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("total"))
    schema = rows.schema
    members, classes, k = [], [], 0
    while True:
        members.append(scratch.save(rows))
        classes.append(
            scratch.save(
                members[-1].groupBy("class").agg(F.count("*").alias("n"), F.min("conv").alias("least"), *[F.first(c).alias(c) for c in ("parent", "depth", "turn", "words", "total")], F.max("length").alias("length"))
            )
        )
        alive = classes[-1].where((F.col("n") > 1) & (F.col("depth") == _last_of(k)))
        if alive.isEmpty():
            break
        active = lookup(members[-1].where(F.col("depth") == _last_of(k)), alive.select("class", "n"), "class", "n").where(F.col("n").isNotNull()).select("conv", "length", "class", "total")
        k += 1
        rows = _split(active, turns.where(F.col("round") == k).select("conv", "depth", "turn", "words"), k <= 4)
    read = lambda tables, schema: spark.read.schema(schema).parquet(*[p for t, p in scratch.tables if any(t is x for x in tables)])
    return read(members, schema), read(classes, classes[0].schema)


def _ends(members: DataFrame) -> DataFrame:
    """(class, ends): SHA-256 of the ids, in order, of the members that end in each class."""
    narrow_batches(members.sparkSession)
    ended = members.where(F.col("depth") == F.col("length"))
    rows = ended.groupBy("class", F.shiftright("conv", ENDS_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for b in batches:
            out = []
            for c, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = c, hashlib.sha256(ids.encode())
            yield _digests(out)
        if at is not None:
            yield _digests([(at, digest.hexdigest())])

    return rows.repartition("class").sortWithinPartitions("class", "part").select("class", "ids").mapInArrow(run, "class binary, ends string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["class", "ends"])


def trie(scratch: Scratch, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of conversations (conv, length) with turns (conv, depth, turn, words); ``turn_sha256`` names a node's turn in ``turn_store``."""
    turns = scratch.save(turns.withColumn("round", _round_of("depth")).sortWithinPartitions("round"))
    members, classes = refine(scratch, convs, turns)
    children = classes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("split"))
    classes = scratch.save(classes.join(children, "class", "left"))
    leaves = classes.where(F.col("split").isNull()).select(F.col("least").alias("conv"), F.lit(1).alias("leaf"))

    shared = lookup(members.select("conv", "class", "total"), classes.where("n > 1").select("class", "n", "least"), "class", "n").where(F.col("n").isNotNull())
    shared = scratch.save(shared.select("conv", "class", F.when(F.col("least") != F.col("conv"), F.col("total")).alias("with_less")))
    brought = shared.groupBy("conv").agg(F.max("with_less").alias("upto"), F.count("*").alias("rows")).join(leaves, "conv", "left").where(F.col("upto").isNotNull() | F.col("leaf").isNotNull())
    sums = lookup(shared, scratch.save(brought), "conv", "rows").groupBy("class").agg(F.sum(F.when(F.col("with_less").isNotNull(), F.col("upto"))).alias("upto"), F.sum("leaf").alias("leaves"))

    above = classes.where(F.col("split").isNotNull()).select(F.col("class").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("split").alias("_split"))
    nodes = lookup(classes, above, "parent", "_split").join(sums, "class", "left").join(_ends(members), "class", "left")
    last = (F.col("n") == 1) & F.col("split").isNull() & (F.col("depth") < F.col("length"))
    saved = F.coalesce("upto", F.lit(0)) - (F.col("n") - 1) * (F.col("total") - F.col("words"))
    of_classes = nodes.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.when(last, 1).otherwise(F.coalesce("split", F.lit(0))).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.when(F.col("n") > 1, saved).otherwise(0).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"), "turn",
    )
    retired = classes.where(last).select(F.col("least").alias("conv"), F.col("depth").alias("_from"), "length", (F.col("length") - F.col("depth")).alias("_left"))
    tails = lookup(turns, retired, "conv", "_left").where(F.col("depth") > F.col("_from"))
    ends = F.when(F.col("depth") < F.col("length"), F.lit(_NOTHING)).otherwise(F.sha2(F.col("conv").cast("string").cast("binary"), 256))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    of_tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"), "turn",
    )
    return of_classes.unionByName(of_tails).withColumn("turn_sha256", F.lower(F.hex("turn"))).drop("turn")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    return trie(scratch, *rebuilt(scratch, table(spark, sf_dir, "conversations")))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

ORACLES = {
    "op11_prefix_trie": r"""
WITH bits AS (
  SELECT list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v, i
  FROM (SELECT unnest(range(256)) AS i)
), crcs AS (
  SELECT list(v ORDER BY i) AS t FROM bits
), raw AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM raw
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b
  FROM (SELECT DISTINCT conv_id FROM raw)
), heads AS (
  SELECT conv_id, base, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM ids, crcs
), mixed AS (
  SELECT c.conv_id, 0 AS part, o.i, o.k, o.words FROM heads c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.k, o.words FROM heads c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
), turns AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix, k, words FROM mixed WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
), members AS (
  SELECT conv_id, depth, prefix, k, words FROM turns
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM heads
), lengths AS (
  SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(k) AS k, string_agg(CAST(CASE WHEN depth = length THEN conv_id END AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY prefix, depth
), kids AS (
  SELECT prefix[:-65] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids c USING (prefix)
), above AS (
  SELECT m.prefix, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256, n.k AS turn_sha256
FROM counted n JOIN above a USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[:-65]
"""
}
