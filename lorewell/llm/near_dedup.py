"""Near-duplicate groups by one-permutation MinHash.

Each document's 4-word shingles are hashed once; the hash gives the bin and the value (one
permutation), empty bins borrow by optimal densification (each empty bin probes bins in an order
of its own until one is full), and BANDS bands of ROWS bins become bucket keys. A bucket gives a
star of candidate edges, so candidates are as many as members; its centre is the member that shares
most buckets with others, which in a family of edited copies is the one closest to all. Every
candidate is confirmed on the full shingle sets. Where confirmed links leave a bucket's members in
several components, small buckets are compared whole and large ones get a further star of their next
member, as long as stars confirm new links. Buckets that are still open then are compared whole, in pairs of
blocks of their members, so every two members of a bucket are compared or in one component already.
After ROUNDS of stars all that is open is compared so, which bounds the number of jobs. Pairs at
similarity 0.8 exactly miss all buckets with a chance of (1 - 0.8^6)^56, about 4e-8.

Equal word sequences are one class with one signature, so thousands of copies cost one row. Links
become components by alternating large-star and small-star steps over written tables.

Defined results: a null text is an empty text; a document without words has an empty set and is
its own component; with fewer words than a shingle the whole sequence is the one shingle; repeated
rows are copies of each other, and rows are told apart by their place, so null and repeated ids do no harm; a component's
id is its least id, null if it has none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.kernels import SPACED, Words, grams, mix, slices, spread, texts
from lorewell.llm.shared import ROW, Scratch, keyed, lookup, narrow_batches, table

BANDS, ROWS = 56, 6
BINS = BANDS * ROWS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and the n + 1 offsets into them."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    g = grams(words.hash, k)
    at = spread(words.first[:-1], count)
    h = np.empty(len(at), np.uint64)
    whole = np.repeat(n >= k, count)
    h[whole] = g[at[whole]]
    for d in np.flatnonzero((n > 0) & (n < k)):  # a short document's one shingle
        x = np.uint64(n[d])
        for y in words.hash[words.first[d] : words.first[d + 1]]:
            x = mix(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y)[0]
        h[np.searchsorted(doc, d)] = x
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64((attempt + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) % np.uint64(BINS)).astype(np.int64)


_PROBES = np.stack([_probe(np.arange(BINS), a) for a in range(64)])


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The BINS values of each document; all EMPTY for an empty set."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    # sets are sorted by hash and the bin is the hash's high part, so a bin's first value is its least
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = doc * BINS + bins
    lead = np.ones(len(h), bool)
    lead[1:] = cell[1:] != cell[:-1]
    sig = np.full(n * BINS, EMPTY, np.uint64)
    sig[cell[lead]] = h[lead]
    full = sig != EMPTY
    some = full.reshape(n, BINS).sum(1)
    for d in np.flatnonzero(some == 1):  # every probe ends in the one full bin
        sig[d * BINS : (d + 1) * BINS] = sig[d * BINS : (d + 1) * BINS][full[d * BINS : (d + 1) * BINS]][0]
    open_ = np.flatnonzero(~full & np.repeat(some > 1, BINS))
    attempt, source = 0, sig.copy()
    while len(open_):
        base, own = open_ - open_ % BINS, open_ % BINS
        step = 8 if attempt else 2
        left = np.ones(len(open_), bool)
        for a in range(attempt, attempt + step):
            to = base + (_PROBES[a][own] if a < len(_PROBES) else _probe(own, a))
            hit = left & full[to]
            sig[open_[hit]] = source[to[hit]]
            left &= ~hit
        open_, attempt = open_[left], attempt + step
    return sig.reshape(n, BINS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
    return key


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = texts(b.column(2))
            for i, j in slices(offs):
                w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], SPACED)
                h, first = shingle_sets(w, k)
                n = np.diff(first)
                keys = band_keys(signatures(h, first))[n > 0]
                each = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0))))
                raw = w.hash.tobytes()
                digest = [hashlib.blake2b(raw[8 * p : 8 * q], digest_size=16).digest() for p, q in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(digest, pa.binary()), pa.array(n.astype(np.int64)), _lists(keys.view(np.int64).ravel(), each)],
                    [ROW, "doc_id", "digest", "n_shingles", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = texts(b.column(1))
            for i, j in slices(offs):
                h, first = shingle_sets(Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], SPACED), k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _lists(h.view(np.int64), first)], ["node", "set"])

    return run


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b) that isn't its component's smallest."""
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.save(edges.select("a", "b").where("a <> b").distinct())
    seen = mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.union(least.select("hi", "m")).distinct())
        scratch.drop(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _joined(scratch: Scratch, roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links: only the components that they touch are joined anew."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = components(scratch, ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    now = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return roots.join(now, "root", "left").select("node", F.coalesce("_to", "root").alias("root")).union(moved.select("node", "root"))


#: Buckets of up to so many members are compared whole where stars leave them open, larger ones after so many rounds of stars.
SMALL, ROUNDS = 8, 24
#: What stars leave of large buckets is compared in blocks of about so many members and at most about so many shingles.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: A centre's edges are dealt to at most so many groups, and its set goes once to each.
GROUPS = 256


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, node, ok) of pairs (c, node)."""
    dealt = pairs.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(GROUPS)))
    centres = dealt.select("c", "_salt").distinct().join(sets.toDF("c", "_cs").hint("merge"), "c")
    both = dealt.join(sets.hint("merge"), "node").join(centres.hint("merge"), ["c", "_salt"])
    shared = F.size(F.array_intersect("set", "_cs"))
    union = F.size("set") + F.size("_cs") - shared
    return both.select("c", "node", (shared * 100 >= union * percent).alias("ok"))


def _forest(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links (a, b) of a few sets: the fewest that join all that links between different roots join."""
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        sets = pa.concat_arrays(rows.column("set").chunks)
        offs, n = sets.offsets.to_numpy(), len(node)
        size = np.diff(offs)
        _, code, count = np.unique(sets.values.to_numpy()[offs[0] : offs[-1]], return_inverse=True, return_counts=True)
        common = count > 1  # shingles of one set only add to its size
        row, col = np.repeat(np.arange(n), size)[common[code]], (np.cumsum(common) - 1)[code[common[code]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        shared, width = np.zeros((n, n), np.float32), max(1, 4_000_000 // n)
        for at in range(0, int(common.sum()), width):
            i, j = np.searchsorted(col, [at, at + width])
            has = np.zeros((n, width), np.float32)
            has[row[i:j], col[i:j] - at] = 1
            shared += has @ has.T
        shared = shared.astype(np.int64)
        ok = (shared * 100 >= (size[:, None] + size[None, :] - shared) * percent) & (root[:, None] != root[None, :])
        left, a, b = ok.any(1), [], []
        for start in np.flatnonzero(left):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                x = todo.pop()
                new = np.flatnonzero(ok[x] & left)
                left[new] = False
                todo += new.tolist()
                a += [x] * len(new)
                b += new.tolist()
        return pa.table({"a": pa.array(node[np.array(a, np.int64)], pa.int64()), "b": pa.array(node[np.array(b, np.int64)], pa.int64())})

    return run


def _whole(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what links between any two members of a bucket (key, node, root) join.

    Members are dealt to blocks, and each pair of blocks is one group. Members in the component ``_r``
    have blocks of their own, which are not compared with each other. Buckets of the same members count once.
    """
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    keys = members.groupBy("key").agg(F.count("*").alias("_n"), mark.alias("_m")).groupBy("_n", "_m").agg(F.min("key").alias("key")).select("key")
    own = members.join(keys, "key").join(sets.select("node", F.size("set").alias("_size")), "node").withColumn("_in", F.col("root") == F.col("_r"))
    blocks = lambda those: F.ceil(F.greatest(F.count_if(those) / BLOCK, F.sum(F.when(those, F.col("_size"))) / BLOCK_SHINGLES))
    parts = own.groupBy("key").agg(blocks(F.col("_in")).alias("_p"), blocks(~F.col("_in")).alias("_q"))
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    dealt = own.join(parts, "key").withColumn("_i", F.when(F.col("_in"), F.col("_q") + place(F.col("_p"))).otherwise(place(F.col("_q"))))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(F.col("_in"), F.col("_q")).otherwise(F.col("_p") + F.col("_q")) - 1)))
    dealt = dealt.select("key", F.least("_i", "_j").alias("_i"), F.greatest("_i", "_j").alias("_j"), "node", "root")
    return dealt.join(sets.hint("merge"), "node").groupBy("key", "_i", "_j").applyInArrow(_forest(percent), "a long, b long").distinct()


def fame(members: DataFrame) -> DataFrame:
    """(node, fame) of members (node, n): how many rows a node's buckets hold, equal ones in the order of a hash and then of the node, so no two are equal."""
    mixed = F.col("_f") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    order = (mixed.cast("decimal(19,0)") * F.lit(Decimal(1 << 63))).cast("decimal(38,0)") + F.col("node").cast("decimal(19,0)")
    return members.groupBy("node").agg(F.sum("n").alias("_f")).select("node", order.cast("decimal(38,0)").alias("fame"))


def near_duplicates(scratch: Scratch, docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ROW, doc_id, n_shingles, component_id, root, _k) of every row: k-word shingles, links at ``percent`` similarity or more.

    ``_k`` numbers the rows; rows with one ``root`` are one component, and rows without words have none.
    """
    narrow_batches(docs.sparkSession)
    scratch = scratch.inner()
    own = keyed(scratch, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select(ROW, "doc_id", "text")
    signed = own.mapInArrow(_signed(k), f"{ROW} struct<f: long, i: long>, doc_id long, digest binary, n_shingles long, bands array<long>")
    signed = scratch.save(signed.withColumn("_k", F.monotonically_increasing_id()))
    classes = scratch.save(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("size"), F.min("_k").alias("node")))

    first = signed.select(ROW, F.col("_k").alias("node"), "bands").join(classes.select("node").hint("merge"), "node")
    rows = first.select("node", F.explode("bands").alias("key"))
    # aggregates are written before they are joined, so that the join's large keys can be split; what grows with the data is merged, not broadcast
    shared = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.save(rows.join(shared.hint("merge"), "key"))
    members, old = scratch.save(members.join(fame(members).hint("merge"), "node")), members
    scratch.drop(old, shared)

    centres = scratch.save(members.groupBy("key").agg(F.max_by("node", "fame").alias("c")))
    pairs = scratch.save(members.join(centres.hint("merge"), "key").where("node <> c").select("c", "node").distinct())
    wanted = members.select("node").distinct().join(signed.select(F.col("_k").alias("node"), ROW), "node")
    text = own.select(ROW, "text").join(wanted.hint("merge"), ROW).select("node", "text")
    sets = scratch.save(text.mapInArrow(_sets(k), "node long, set array<long>"))
    tested = scratch.save(_confirmed(pairs, sets, percent))
    as_edges = lambda rows: rows.where("ok").select(F.col("c").alias("a"), F.col("node").alias("b"))
    roots = components(scratch, as_edges(tested))
    for left_rounds in range(ROUNDS - 1, -1, -1):
        # a bucket stays open while members that were no centre yet lie in different components
        spent = members.groupBy("key").agg(F.max_by("node", "fame").alias("node"))
        left = members.join(spent, ["key", "node"], "left_anti").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        live = left.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.max_by("node", "fame").alias("c"), F.max_by("root", "fame").alias("_r"))
        members = scratch.save(left.join(scratch.save(live.where("_a <> _b").drop("_a", "_b")).hint("merge"), "key"))
        far = members.where("node <> c and root <> _r").select("c", "node")
        few = members.where(F.col("n") <= SMALL)
        each = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key and x.fame > y.fame and x.root <> y.root")).select(F.col("x.node").alias("c"), F.col("y.node").alias("node"))
        large = members.where(F.col("n") > SMALL)
        more = scratch.save(_confirmed(far.union(each).distinct().join(tested, ["c", "node"], "left_anti"), sets, percent))
        if more.where("ok").isEmpty():
            break
        tested, members = scratch.save(tested.union(more)), large.select("node", "key", "n", "fame")
        roots = scratch.save(_joined(scratch, roots, as_edges(more)))
        if not left_rounds:
            large = members.join(roots.withColumnRenamed("root", "_now"), "node", "left").withColumn("root", F.coalesce("_now", "node"))
            best = large.groupBy("key").agg(F.max_by("root", "fame").alias("_r"))
            large = large.join(scratch.save(best), "key")
    if not large.isEmpty():
        links = scratch.save(_whole(large, sets, percent))
        if not links.isEmpty():
            roots = scratch.save(_joined(scratch, roots, links))

    labelled = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("min_id").alias("component_id"))
    labelled = scratch.save(labelled.join(least, "root").select("digest", "size", "root", "component_id"))
    out = lookup(signed.select(ROW, "doc_id", "digest", "n_shingles", "_k"), labelled, "digest", "size")
    own_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = scratch.save(out.select(ROW, "doc_id", "n_shingles", own_id, "root", "_k"))
    scratch.only(out)
    return out


def dropped(groups: DataFrame) -> DataFrame:
    """ROW of all rows of ``near_duplicates`` but the one that stays of each component: one with the least id, and of several the first."""
    stay = groups.where(F.col("root").isNotNull() & kept()).groupBy("root").agg(F.min("_k").alias("_k"))
    return groups.where(F.col("root").isNotNull()).join(stay.select("_k"), "_k", "left_anti").select(ROW)


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(Scratch(spark, "op8"), table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", kept().alias("kept"))


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}

ORACLES = {
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), ids AS (
  SELECT doc_id, n, hash(g) AS g FROM shingles
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM ids a JOIN ids b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c USING (doc_id)
"""
}
