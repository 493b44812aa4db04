"""Mixing sources to target weights by weighted fair queueing.

Native: built-in functions only. Targets share a budget of words by weight; a target stops at
``cap`` times its source's size and the excess is reshared by weight (water filling). Each source
shuffles its documents by a hash of id and text and serves them in that order, ``cap`` times over. A
document's virtual finish time is the source's words served up to its end over the source's
target. All services of all sources are range-sorted by finish time, and the one running sum of
their words is cut where it reaches the budget; no source has a quota of its own. At that point a source
may be in the middle of a document, so the document that a source serves at time 1, when all targets would be
met, is served in up to PACKETS packets. Each source thus takes its target to within a packet or two
(1/PACKETS of one document), and all take the budget exactly.

Running sums come from range sorts that split any group, so a hot source, many null ids or many copies
of one row meet in no task.

Defined results: a null text has size 0; null sources are one source, after all others; a document
of size 0 takes nothing; repeated rows are served separately; an empty table gives no rows, a
table without words targets 0; only the id, source and text columns are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import ROW, Scratch, keyed, null_to_empty, range_sorted, table

PACKETS, SEED = 1024, 7
SPACED_WORDS = "[^\\x20\\x09-\\x0D]+"


def words(text: str) -> Column:
    return F.regexp_count(null_to_empty(text), F.lit(SPACED_WORDS)).cast("long")


def shuffled(seed: int) -> Column:
    """Sorts a source's documents at random, alike in each run and wherever they are stored."""
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(null_to_empty("text"), "UTF-8")))
    return F.substring(F.md5(F.encode(own, "UTF-8")), 1, 16)


def targets(scratch: Scratch, sizes: DataFrame, share: float, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, float]:
    """``sizes`` (source, _null, source_size and more) with target, and the whole budget."""
    rank = range_sorted(scratch, sizes, ["_null", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    rank = scratch.save(rank.withColumn("_w", weight).drop("_pos"))
    total, free = rank.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    budget = min(share, cap) * total
    left, most = budget, F.col("source_size") * float(cap)
    above = F.lit(False)
    while free:  # each step caps further sources; two numbers come to the driver
        above = F.lit(left) * F.col("_w") / F.lit(free) > most
        capped, now = rank.agg(F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0))).first()
        if now == free:
            break
        left, free = budget - capped, now
    fair = F.lit(left) * F.col("_w") / F.lit(free) if free else most
    return rank.withColumn("target", F.when(above, most).otherwise(fair)).drop("_w"), budget


def mix(scratch: Scratch, docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, services).

    rows: ROW, doc_id, source, size, source_size, target, _row of every document. services: _row, epoch,
    packet, words, position, finish of what the mix takes, in the order of position.
    """
    narrow = keyed(scratch, docs.select("doc_id", "source", "text")).select(
        ROW, "doc_id", F.col("source").alias("_source"), null_to_empty("source").alias("source"), F.col("source").isNull().cast("int").alias("_null"),
        words("text").alias("size"), shuffled(seed).alias("_hash"),
    )
    narrow = scratch.save(narrow.withColumn("_row", F.monotonically_increasing_id()))
    line = scratch.save(range_sorted(scratch, narrow, ["_null", "source", "_hash", "doc_id", "size", "_row"], "size"))
    key = ["_null", "source"]
    sizes = line.groupBy(*key).agg(F.sum("size").alias("source_size"), F.min(F.col("_sum") - F.col("size")).alias("_start"))
    sizes, budget = targets(scratch, sizes, share, weights, cap)
    rows = scratch.save(line.join(sizes, key).withColumn("_end", F.col("_sum") - F.col("_start")))

    served = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    served = served.withColumn("_before", F.col("_end") - F.col("size") + F.col("epoch") * F.col("source_size"))
    open_ = (F.col("_before") < F.col("target")) & (F.col("_before") + F.col("size") > F.col("target"))
    served = served.withColumn("_of", F.when(open_, F.least("size", F.lit(PACKETS))).otherwise(1)).withColumn("packet", F.explode(F.expr("sequence(1L, CAST(_of AS BIGINT))")))
    upto = lambda p: F.expr(f"size * ({p}) DIV _of")
    served = served.withColumn("words", upto("packet") - upto("packet - 1")).withColumn("finish", (F.col("_before") + upto("packet")) / F.col("target"))
    served = served.select("_row", "doc_id", "_hash", "epoch", "packet", "finish", "words")
    taken = range_sorted(scratch, served, ["finish", "_hash", "doc_id", "epoch", "packet", "_row"], "words")
    left = F.floor(F.lit(budget)) - F.col("_sum") + F.col("words")
    taken = taken.where(left > 0).select("_row", "epoch", "packet", F.least("words", left).alias("words"), F.col("_pos").alias("position"), "finish")
    return rows.select(ROW, "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "_row"), taken


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, services = mix(Scratch(spark, "op7"), table(spark, sf_dir, "documents"))
    taken = services.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    out = rows.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


QUERIES = {"op7_mixing": op7_mixing}

ORACLES = {
    "op7_mixing": r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(source IS NULL AS INT) AS missing, row_number() OVER () AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 16) AS h
  FROM documents
), sources AS (
  SELECT missing, source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY missing, source) - 1 AS pos FROM docs GROUP BY 1, 2
), weighed AS (
  SELECT *, CAST(CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS most,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources
), filled AS (
  SELECT *, coalesce(sum(most) OVER p, 0) AS full_before, coalesce(sum(w) OVER p, 0) AS w_before, sum(w) OVER () AS w_all
  FROM weighed WINDOW p AS (ORDER BY most / w, missing, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, (budget - full_before) * w / (w_all - w_before) > most AS above FROM filled
), aimed AS (
  SELECT missing, source, source_size, budget, CASE WHEN above THEN most
    ELSE (budget - coalesce(sum(most) FILTER (above) OVER (), 0)) * w / (w_all - coalesce(sum(w) FILTER (above) OVER (), 0)) END AS target
  FROM capped
), lined AS (
  SELECT d.*, a.source_size, a.target, a.budget, CAST(sum(size) OVER (PARTITION BY missing, source ORDER BY h, doc_id, size, place) - size AS BIGINT) AS before
  FROM docs d JOIN aimed a USING (missing, source)
), served AS (
  SELECT *, before + epoch * source_size AS since FROM lined, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0
), cut AS (
  SELECT *, CASE WHEN since < target AND since + size > target THEN least(size, 1024) ELSE 1 END AS parts FROM served
), packets AS (
  SELECT *, unnest(range(1, parts + 1)) AS p FROM cut
), timed AS (
  SELECT *, size * p // parts - size * (p - 1) // parts AS words, (since + size * p // parts) / target AS finish FROM packets
), queue AS (
  SELECT *, row_number() OVER w - 1 AS position, floor(budget) - (sum(words) OVER w - words) AS room
  FROM timed WINDOW w AS (ORDER BY finish, h, doc_id, epoch, p, place)
), taken AS (
  SELECT place, CAST(sum(least(words, room)) AS BIGINT) AS taken, min(position) AS position FROM queue WHERE room > 0 GROUP BY 1
)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0) AS taken, t.position FROM lined l LEFT JOIN taken t USING (place)
"""
}
