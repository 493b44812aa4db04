"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items become SEED-word seeds. One pass over the documents finds the places of all seeds, takes for
each document and item with a hit the words around the hits (as numbers of the item's own words), and aligns
every such window, however common its seeds are; equal windows are aligned once per task. Only windows
that share too few words with the item to reach the least score are left out, which changes no result: an alignment
matches no more words than both have. So a document's result depends on no other document. Score is the local
alignment's score over that of the whole item, and pairs of MIN_SCORE or more are reported. A copy
without any SEED unedited words in a row has no seed and is not found.

Items are scanned in blocks of BLOCK_WORDS words, which bounds what the driver holds and each task gets.

Defined results: null texts are empty and match nothing; items shorter than a seed are matched by
their whole word sequence; repeated documents with one id give one row per item; empty tables give
no rows; other columns are not read. Case and punctuation don't count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.kernels import ALNUM, Words, grams, slices, texts
from lorewell.llm.shared import Scratch, col, narrow_batches, table

SEED, MIN_SCORE, BLOCK_WORDS = 4, 0.5, 2_000_000
#: A task keeps so many alignments of earlier windows.
RECENT = 4096
MATCH, MISMATCH, GAP = 2, -1, -1


class Block:
    """Some test items: their words, and their seeds as a sorted table of (hash, item, place)."""

    def __init__(self, items: list[tuple[int, str]]):
        ids = [i for i, _ in items]
        buf, offs = texts(pa.array([t for _, t in items], pa.string()))
        w = Words(buf, offs, ALNUM)
        self.items: list[tuple[int, np.ndarray]] = []
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for k, i in enumerate(ids):
            h = w.hash[w.first[k] : w.first[k + 1]]
            n = min(SEED, len(h))
            self.items.append((i, h))
            if n:
                seeds[n].append((grams(h, n), np.full(len(h) - n + 1, k)))
        self.seeds = {}
        for n, found in seeds.items():
            g, k = np.concatenate([g for g, _ in found]), np.concatenate([k for _, k in found])
            at = np.concatenate([np.arange(len(g)) for g, _ in found])
            order = np.argsort(g, kind="stable")
            self.seeds[n] = (g[order], k[order], at[order])

    def hits(self, w: Words) -> list[tuple[int, int, int, int, np.uint64]]:
        """(document, item, word, place in the item, seed) of all places."""
        out = []
        for n, (g, item, at) in self.seeds.items():
            own = grams(w.hash, n)
            lo = np.searchsorted(g, own, "left")
            hit = np.flatnonzero((lo < len(g)) & (g[np.minimum(lo, len(g) - 1)] == own))
            doc = np.searchsorted(w.first, hit, "right") - 1
            inside = hit + n <= w.first[doc + 1]
            for p, d, a, b in zip(hit[inside], doc[inside], lo[hit[inside]], np.searchsorted(g, own[hit[inside]], "right"), strict=True):
                out += [(int(d), int(item[k]), int(p), int(at[k]), g[k]) for k in range(a, b)]
        return out

    def windows(self, w: Words) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
        """(document, item, first word, words as places in the item's vocabulary or -1, number of seeds) for each group of hits."""
        by: dict[tuple[int, int], list[tuple[int, int, np.uint64]]] = defaultdict(list)
        for d, k, p, at, g in self.hits(w):
            by[d, k].append((p - at, p, g))
        for (d, k), found in by.items():
            h = self.items[k][1]
            size, found = len(h), sorted(found)
            groups = [[found[0]]]
            for x in found[1:]:
                if x[0] - groups[-1][-1][0] > size:
                    groups.append([])
                groups[-1].append(x)
            for group in groups:
                pad = size // 4 + 4
                a = max(int(w.first[d]), group[0][0] - pad)
                b = min(int(w.first[d + 1]), group[-1][0] + size + pad)
                yield d, k, a - int(w.first[d]), coded(h, w.hash[a:b]), len({int(g) for _, _, g in group})


def coded(item: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Each word's rank among the item's distinct words; -1 for other words."""
    v = np.unique(item)
    at = np.minimum(np.searchsorted(v, other), len(v) - 1)
    return np.where(v[at] == other, at, -1).astype(np.int32)


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment's score over the item's best, and where it ends in the window (words, exclusive)."""
    n = len(window)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    gaps = -GAP * np.arange(n + 1)
    for c in item:
        diagonal = row[:-1] + np.where(window == c, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], diagonal)
        row = np.maximum.accumulate(new + gaps) - gaps
        row[0] = 0
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best / (MATCH * len(item)), end


def bound(item: np.ndarray, window: np.ndarray) -> float:
    """At least the score of any alignment: words that both have, repeats counted, over the item's."""
    n = int(item.max()) + 1
    return int(np.minimum(np.bincount(item, minlength=n), np.bincount(window[(window >= 0) & (window < n)], minlength=n)).sum()) / len(item)


class Aligner:
    """Scores of the windows of a block's items; those of the last RECENT different windows are kept."""

    def __init__(self, block: Block, min_score: float):
        self.block, self.min_score = block, min_score
        self.score = lru_cache(RECENT)(self._score)

    def _score(self, k: int, window: bytes) -> tuple[float, int]:
        item, words = coded(self.block.items[k][1], self.block.items[k][1]), np.frombuffer(window, np.int32)
        return align(item, words) if bound(item, words) >= self.min_score else (-1.0, 0)

    def found(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, float, int]]]]:
        """For each range of texts: its first text, and (text in the range, item, seeds, score, end word) of what reaches the least score."""
        buf, offs = texts(column)
        for i, j in slices(offs):
            w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
            scored = ((d, k, n, *self.score(k, window.tobytes()), first) for d, k, first, window, n in self.block.windows(w))
            yield i, [(d, k, n, s, first + end) for d, k, n, s, end, first in scored if s >= max(self.min_score, 0)]


def _aligned(block: Block, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(block, min_score)
        for b in batches:
            for i, rows in aligner.found(b.column(1)):
                if rows:
                    docs = b.column(0).take(pa.array([i + r[0] for r in rows]))
                    item = pa.array([block.items[r[1]][0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [docs, item, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.int64())],
                        ["doc_id", "item_id", "n_seeds", "score", "end_word"],
                    )

    return run


def _without(block: Block, min_score: float, text: int):
    """Batches of one struct column, without the rows whose field ``text`` holds a copy of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(block, min_score)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, rows in aligner.found(b.column(0).flatten()[text]):
                clean[[i + r[0] for r in rows]] = False
            if clean.any():
                yield b.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    items, size = [], 0
    for i, t in benchmark.toLocalIterator():
        items.append((i, t or ""))
        size += len(t or "") // 5 + 1
        if size > BLOCK_WORDS:
            yield items
            items, size = [], 0
    if items:
        yield items


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    return _blocks(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")))


def contaminated(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_seeds, end_word) of the documents that hold a copy, edited or not, of an item."""
    spark = docs.sparkSession
    narrow_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = "doc_id long, item_id long, n_seeds long, score double, end_word long"
    scored = spark.createDataFrame([], fields)
    for items in _items(benchmark):
        scored = scored.union(scratch.save(own.mapInArrow(_aligned(Block(items), min_score), fields)))
    best = F.max(F.struct("score", "n_seeds", (-F.col("end_word")).alias("e"))).alias("best")
    best = scored.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "best.score", "best.n_seeds", (-F.col("best.e")).alias("end_word"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a copy of an item. Each row is judged by its own text in a narrow pass, whatever its id."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"))
    schema, at = rows.schema, docs.columns.index(text_col)
    for items in _items(benchmark):
        rows = rows.mapInArrow(_without(Block(items), min_score, at), schema)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(Scratch(spark, "op4"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLES: dict[str, str] = {}
