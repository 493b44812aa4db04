"""Hilbert-curve sharding: quantised metadata become curve cells, and runs of the curve become shards.

Native: built-in functions only. Each row's cell is its place on a Hilbert curve through three
quantised dimensions (source, language, length), computed by a fold over the curve's bit planes.
Sources and languages are quantised by their rank among the distinct values, so neighbours on the curve are
neighbours in value and a shard's least and greatest values tell readers what it can't hold. Rows are numbered by
a range sort on (cell, id, ties, place), which splits a hot cell wherever it must, and joined back by place.
Law ``rows``: the run is cut so that counts differ by at most one.

Defined results: null metadata are the dimension's zero; a null text has size 1 and CRC 0; repeated
rows are kept and take places side by side, in any order among equals; null ids come first in a cell; an empty table gives no
rows; with fewer rows than shards some shards are empty; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lorewell.llm.shared import ROW, Scratch, col, keyed, null_to_empty, range_sorted, table

BITS = 5


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve through the cube of len(axes) dimensions of ``bits`` bits each.

    Gray-code walk from the highest bit plane down: at each plane the cell's corner is decoded in
    the frame that the planes above have turned (entry corner and main axis), and the frame is
    turned on. State: (index so far, entry corner, axis).
    """
    n = len(axes)
    full = (1 << n) - 1
    planes = F.array(*[
        sum((F.shiftleft(F.shiftright(a, b).bitwiseAND(1), i) for i, a in enumerate(axes[1:], 1)), F.shiftright(axes[0], b).bitwiseAND(1))
        for b in range(bits - 1, -1, -1)
    ])

    # frames and digits depend on (entry, axis, corner) alone: tables of n * 4^n small numbers, built by rule
    ror = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & full if k % n else x
    rol = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full if k % n else x

    def unray(g: int) -> int:
        x = 0
        while g:
            x ^= g
            g >>= 1
        return x

    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    turn = lambda i: 0 if i == 0 else trailing(i - 1) % n if i % 2 == 0 else trailing(i) % n
    step = []
    for axis in range(n):
        for at in range(1 << n):
            for corner in range(1 << n):
                w = unray(ror(corner ^ at, axis + 1))
                nxt = at ^ rol(entry(w), axis + 1)
                step.append((w << 8) | (((axis + turn(w) + 1) % n) << n | nxt))
    steps = F.array(*[F.lit(x) for x in step])

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("f"))
    def walk(acc: Column, corner: Column) -> Column:
        s = F.element_at(steps, F.shiftleft(acc["f"], n) + corner.cast("int") + 1)
        return F.struct((F.shiftleft(acc["h"], n) + F.shiftright(s, 8)).alias("h"), s.bitwiseAND(255).alias("f"))
    return F.aggregate(planes, start, walk)["h"]


#: An octave is halved: n is in step k when n + 1 is the first integer from sqrt(2)^k on, or more.
STEPS = [math.isqrt((1 << k) - 1) + 1 for k in range(1, 1 << BITS)]


def rank_axis(scratch: Scratch, rows: DataFrame, column: str) -> Column:
    """A quantised text dimension that keeps its order: null first, then equal numbers of distinct values on each of the axis's steps.

    At most 2^BITS values, the steps' least ones, come to the driver.
    """
    top = 1 << BITS
    values = range_sorted(scratch, rows.select(F.col(column).alias("v"), F.col(column).isNotNull().alias("has")).distinct(), ["has", "v"])
    values = scratch.save(values)
    step = F.expr(f"_pos * {top} DIV {max(values.count(), 1)}").cast("int")
    least = values.groupBy(step.alias("step")).agg(F.min("_pos").alias("_pos")).join(values, "_pos").orderBy("step").collect()
    axis = F.lit(0)
    for r in least:
        if r.has:
            axis = F.when(F.col(column) >= F.lit(r.v), r.step).otherwise(axis)
    return axis


def length_axis(length: Column) -> Column:
    """The number of half octaves, from whole numbers alone."""
    n = F.coalesce(length, F.lit(0)) + 1
    return sum(((n >= t).cast("int") for t in STEPS[1:]), (n >= STEPS[0]).cast("int"))


def shard(scratch: Scratch, docs: DataFrame, shards: int, keep: list[str], id_col: str = "doc_id", ties: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row, cell, shard (0 to shards - 1, law rows) and slot in it (gapless from 0).

    Rows of a cell are in the order of id, then of ``ties``, then of their places in the files.
    """
    docs = keyed(scratch, docs)
    scratch = scratch.inner()
    fixed = {f.name for f in docs.schema if isinstance(f.dataType, NumericType)}
    carried = list(dict.fromkeys([id_col, *(ties or []), *(keep if set(keep) <= fixed else [])]))
    narrow = scratch.save(docs.select(ROW, *carried, F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("n_chars").alias("_length")))
    axes = [rank_axis(scratch, narrow, "_source"), rank_axis(scratch, narrow, "_lang"), length_axis(F.col("_length"))]
    total = narrow.count()
    rows = narrow.select(ROW, *carried, hilbert_index(axes).alias("cell"))
    rank = range_sorted(scratch, rows, ["cell", id_col, *(ties or []), ROW])
    out = rank.withColumn("shard", F.expr(f"CAST(_pos * {shards} DIV {max(total, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    out = out.withColumn("slot", F.col("_pos") - first)
    if set(keep) <= fixed:
        return out.select(*keep, "cell", "shard", "slot")
    placed = scratch.save(out.select(ROW, F.struct("cell", "shard", "slot").alias("_placed")))
    scratch.only(placed)
    found = docs.select(ROW, F.struct(*map(col, keep)).alias("_kept")).join(placed, ROW)
    return found.select(*[F.col("_kept")[c].alias(c) for c in keep], "_placed.cell", "_placed.shard", "_placed.slot")


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = null_to_empty("text")
    docs = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard(Scratch(spark, "op3"), docs, 16, ["doc_id", "size", "text_crc32"], ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


QUERIES = {"op3_hilbert_sharding": op3_hilbert_sharding}


def _walk_sql() -> str:
    """The walk of three dimensions in SQL, a plane at a time: at entry corner e and axis d, corner c is digit w of the curve."""
    ctes = ["w5 AS (SELECT *, 0 AS h, 0 AS e, 0 AS d FROM axes)"]
    for b in range(BITS - 1, -1, -1):
        ctes.append(f"c{b} AS (SELECT *, xor(((x >> {b}) & 1) + 2 * ((y >> {b}) & 1) + 4 * ((z >> {b}) & 1), e) AS u, (d + 1) % 3 AS k FROM w{b + 1})")
        ctes.append(f"r{b} AS (SELECT *, ((u >> k) | (u << (3 - k))) & 7 AS r FROM c{b})")
        ctes.append(f"d{b} AS (SELECT *, xor(xor(r, r >> 1), r >> 2) AS w FROM r{b})")
        ctes.append(f"f{b} AS (SELECT *, [0, 0, 0, 3, 3, 6, 6, 5][w + 1] AS q, [0, 1, 1, 2, 2, 1, 1, 0][w + 1] AS g FROM d{b})")
        ctes.append(f"w{b} AS (SELECT * EXCLUDE (h, e, d, u, k, r, w, q, g), h * 8 + w AS h, xor(e, ((q << k) | (q >> (3 - k))) & 7) AS e, (d + g + 1) % 3 AS d FROM f{b})")
    return ",\n".join(ctes)


ORACLES = {
    "op3_hilbert_sharding": rf"""
WITH bits AS (
  SELECT list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v, i
  FROM (SELECT unnest(range(256)) AS i)
), crcs AS (
  SELECT list(v ORDER BY i) AS t FROM bits
), bytes AS (
  SELECT doc_id, source, lang, coalesce(n_chars, 0) + 1 AS n, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b
  FROM documents
), docs AS (
  SELECT doc_id, source, lang, n, size, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS crc FROM bytes, crcs
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM docs)
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM docs)
), axes AS (
  SELECT d.doc_id, d.size, d.crc, s.p * 32 // s.n AS x, l.p * 32 // l.n AS y,
    len(list_filter(range(1, 32), lambda k: CAST(d.n AS HUGEINT) * d.n >= CAST(1 AS HUGEINT) << CAST(k AS INT))) AS z
  FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang
),
{_walk_sql()},
ranked AS (
  SELECT doc_id, size, crc, h AS cell, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size, crc) - 1 AS p, count(*) OVER () AS total FROM w0
), placed AS (
  SELECT *, p * 16 // total AS shard FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, p - (shard * total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard, CAST(cell AS BIGINT) AS cell
FROM placed
"""
}
