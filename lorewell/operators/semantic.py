"""Vector neighbours in blocks, suggestions, clusters, and the graph and terms of communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus, Settings
from lorewell.functions.runtime import ship, written

#: Vectors, and queries, of which one task compares all pairs.
BLOCK = 4096
#: Vectors of a block where all are compared with all; its rows are compared PAIR_ROWS at a time.
PAIR_BLOCK, PAIR_ROWS = 16_384, 256
#: Members of a cluster whose similarities to all earlier ones are held at once.
PART_ROWS = 256
COMMUNITY_EDGES = ["references", "depends_on", "contradicts", "supports", "extends", "replaces", "results_in", "same_as", "broader", "narrower", "related"]
CLIQUE = 64


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


PAIRS = "origin string, id string, score double"


def _best(k: int, least: float):
    """Of one group (query rows and others): each query's k most similar others, itself excluded; all at ``least`` or above where k is 0."""

    def run(g: pa.Table) -> pa.Table:
        asks = g.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = g.column("id").to_numpy(zero_copy_only=False)
        m = _unit(np.array(g.column("vector").to_pylist(), np.float64).reshape(len(ids), -1))
        mine, own, m, q = ids[asks], ids[~asks], m[~asks], m[asks]
        order = np.argsort(own)
        own, m = own[order], m[order]
        parts: list[tuple] = [(mine[:0], own[:0], np.zeros(0))]
        for a in range(0, len(mine), 512):
            s = np.round(q[a : a + 512] @ m.T, 6)
            s[(s < least) | (mine[a : a + 512, None] == own[None, :])] = -2
            if k and len(own) > k:
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are in order, so equal scores stay in the order of ids
            else:
                at = np.broadcast_to(np.arange(len(own)), s.shape)
            score = np.take_along_axis(s, at, 1)
            r, c = np.nonzero(score > -2)
            parts.append((mine[a + r], own[at[r, c]], score[r, c]))
        x, y, z = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table({"origin": pa.array(x, pa.string()), "id": pa.array(y, pa.string()), "score": pa.array(z, pa.float64())})

    return run


def _compared(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(origin, id, score) of queries (cell, id, vector) against the vectors (cell, id, vector) of their cells.

    A cell's vectors and queries are dealt to blocks of about BLOCK rows, and each pair of blocks is one group, however large the cell.
    """
    ship(vectors.sparkSession)
    parts = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    size = parts(vectors, "_v").join(parts(queries, "_q"), "cell")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = vectors.join(size, "cell").select("cell", place("_v").alias("_i"), every("_q").alias("_j"), "id", "vector", F.lit(False).alias("asks"))
    ask = queries.join(size, "cell").select("cell", every("_v").alias("_i"), place("_q").alias("_j"), "id", "vector", F.lit(True).alias("asks"))
    found = own.unionByName(ask).groupBy("cell", "_i", "_j").applyInArrow(_best(k, least), PAIRS)
    if not k:
        return found
    best = W.partitionBy("origin").orderBy(F.desc("score"), "id")
    return found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(origin, id, score): the k most similar vectors of each query by cosine, itself excluded; all at ``least`` or above where k is 0.

    Exact: each block of queries meets each block of vectors once. Its work is their product; ``VectorIndex`` compares fewer.
    """
    one = lambda df: df.select(F.lit(0).alias("cell"), "id", F.col("vector").cast("array<double>").alias("vector"))
    return _compared(one(vectors), one(queries), k, least)


class VectorIndex:
    """An inverted file: vectors by the nearest of ``cells`` directions, which are fitted by k-means on at most ``sample`` vectors.

    Every vector is in its cell. A query is compared, by its true similarity, with the vectors of the ``probes`` cells nearest to it.
    """

    def __init__(self, vectors: DataFrame, cells: int = 64, sample: int = 20_000, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        ship(vectors.sparkSession)
        rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("vector").alias("features"))
        fitted = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(written(some.select(F.col("features"))))
        self.centres = _unit(np.array(fitted.clusterCenters(), np.float64))  # cells vectors
        self.cells = written(self._placed(rows, 1))

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """(cell, id, vector) of each row's ``probes`` nearest cells."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                m = np.array(b.column(1).to_pylist(), np.float64)
                near = np.argsort(-(_unit(m) @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["cell", "id", "vector"])

        return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "cell int, id string, vector array<double>")

    def search(self, queries: DataFrame, k: int, least: float, probes: int = 8) -> DataFrame:
        """(origin, id, score): of each query the k most similar vectors of the cells probed; all at ``least`` or above where k is 0."""
        return _compared(self.cells, self._placed(queries, probes), k, least)


def _above(least: float):
    """Of one group (the vectors of one block, and of a later one or the same): the pairs at ``least`` or above, the smaller id first."""

    def run(g: pa.Table) -> pa.Table:
        ids = g.column("id").combine_chunks()
        m = _unit(g.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(g.num_rows, -1))
        first = g.column("first").to_numpy(zero_copy_only=False).astype(bool)
        one = bool(g.column("same")[0].as_py())
        x = np.flatnonzero(first)
        y = x if one else np.flatnonzero(~first)
        mine, other = m[x], m[y]
        parts: list[tuple] = [(x[:0], x[:0], np.zeros(0))]
        for a in range(0, len(x), PAIR_ROWS):
            s = mine[a : a + PAIR_ROWS] @ other.T
            r, c = np.nonzero(s >= least - 1e-6)  # rounding moves no score so far; of the few that are left all is exact
            score = np.round(s[r, c], 6)
            kept = (score >= least) & (r + a < c if one else True)
            parts.append((x[a + r[kept]], y[c[kept]], score[kept]))
        i, j, score = (np.concatenate([p[k] for p in parts]) for k in range(3))
        left, right = ids.take(pa.array(i)), ids.take(pa.array(j))
        turned = pc.greater(left, right)
        kept = pc.not_equal(left, right)
        return pa.table({"a": pc.if_else(turned, right, left), "b": pc.if_else(turned, left, right), "score": pa.array(score)}).filter(kept)

    return run


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all pairs at ``least`` or above, a before b.

    Exact and all pairs, each once: vectors are dealt to blocks of about PAIR_BLOCK rows, and two blocks, or one with itself, are one group.
    """
    ship(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // PAIR_BLOCK))
    own = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = own.select("id", "vector", "_b", other.alias("_o")).select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "id", "vector", (F.col("_b") <= F.col("_o")).alias("first"), (F.col("_b") == F.col("_o")).alias("same"))
    return rows.groupBy("_i", "_j").applyInArrow(_above(least), "a string, b string, score double")


def link_suggestions(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(src, dst, score): of each query's k nearest notes at ``least`` or above, those that no link of any kind leads to, or from."""
    near = neighbours(vectors, queries, k, least).select(F.col("origin").alias("src"), F.col("id").alias("dst"), "score")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return near.join(both, ["src", "dst"], "left_anti")


def unlinked(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): notes with a vector and no outgoing edge."""
    return vectors.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def suggestions(corpus: Corpus, queries: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """(a, b, relation, score) of unordered pairs: duplicate, link or contradiction; linked pairs give none."""
    near = neighbours(corpus.vectors, queries, k, s.link_low)
    pairs = near.select(F.least("origin", "id").alias("a"), F.greatest("origin", "id").alias("b"), "score").distinct()
    linked = corpus.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    fresh = pairs.join(linked, ["a", "b"], "left_anti")
    own = corpus.notes.select("id", "anchors")
    rows = fresh.join(own.toDF("a", "_x"), "a", "left").join(own.toDF("b", "_y"), "b", "left")
    share = F.coalesce(F.arrays_overlap("_x", "_y"), F.lit(False))
    relation = F.when(F.col("score") >= s.merge_below, "duplicate").when(F.col("score") >= s.link_high, "link").when(share, "link").otherwise("contradiction")
    return rows.select("a", "b", relation.alias("relation"), "score")


def complete_link(members: DataFrame, vectors: DataFrame, least: float, volume: int) -> DataFrame:
    """(cluster, id, part): greedy complete-link parts of the clusters (cluster, id) of ``volume`` members or more, in id order.

    The greedy order is the operator's meaning, so one cluster is one task; its members' vectors must fit there. Similarities are
    computed for PART_ROWS members at a time, and each member looks only at those that are similar to it: it joins the first part of which all are.
    """
    ship(members.sparkSession)
    big = members.groupBy("cluster").agg(F.count("*").alias("_n")).where(F.col("_n") >= volume)
    rows = members.join(big, "cluster", "left_semi").join(vectors.select("id", "vector"), "id")

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("id")
        m = _unit(g.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(g.num_rows, -1))
        of, size, n = np.zeros(len(m), np.int32), np.zeros(len(m), np.int64), 0
        for a in range(0, len(m), PART_ROWS):
            b = min(a + PART_ROWS, len(m))
            near = np.round(m[a:b] @ m[:b].T, 6) >= least
            for i in range(a, b):
                parts, similar = np.unique(of[np.flatnonzero(near[i - a, :i])], return_counts=True)
                whole = parts[similar == size[parts]]
                of[i] = p = whole[0] if len(whole) else n
                n += p == n
                size[p] += 1
        return pa.table({"cluster": g.column("cluster"), "id": g.column("id"), "part": pa.array(of, pa.int32())})

    return rows.select("cluster", "id", "vector").groupBy("cluster").applyInArrow(run, "cluster string, id string, part int")


def weighted_graph(corpus: Corpus) -> DataFrame:
    """(a, b, w) of unordered pairs: 1 for each edge, and 1 for each shared anchor (all pairs up to CLIQUE members, else a star).

    Notes and anchors are joined by sorting, so that none go through the driver.
    """
    at = lambda c: corpus.notes.select(F.col("id").alias(c)).hint("merge")
    links = corpus.edges.where(F.col("kind").isin(*COMMUNITY_EDGES)).distinct()
    links = links.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi").where("src <> dst")
    own = corpus.notes.select("id", F.explode("anchors").alias("anchor")).distinct()
    size = own.groupBy("anchor").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    own = own.join(size.hint("merge"), "anchor")
    few = own.where(F.col("n") <= CLIQUE).select("anchor", "id")
    clique = few.toDF("anchor", "src").join(few.toDF("anchor", "dst").hint("merge"), "anchor").where("src < dst").select("src", "dst")
    star = own.where((F.col("n") > CLIQUE) & (F.col("id") != F.col("hub"))).select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    rows = links.select("src", "dst").union(clique).union(star)
    return rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))


def community_terms(corpus: Corpus, found: DataFrame, k: int = 8) -> DataFrame:
    """(community, position, term): each community's most frequent content terms."""
    from lorewell.functions.text import content_terms

    rows = corpus.notes.join(found, "id").select("community", F.explode(content_terms("statement")).alias("term")).groupBy("community", "term").agg(F.count("*").alias("n"))
    order = W.partitionBy("community").orderBy(F.desc("n"), "term")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("community", "position", "term")


def embedding_state(notes: DataFrame, index: DataFrame) -> DataFrame:
    """(id, state): pending without a vector, indexed if the vector is of the present text, else stale; both have body_hash."""
    rows = notes.select("id", "body_hash").join(index.select("id", F.col("body_hash").alias("_h")), "id", "left")
    return rows.select("id", F.when(F.col("_h").isNull(), "pending").when(F.col("_h") == F.col("body_hash"), "indexed").otherwise("stale").alias("state"))
