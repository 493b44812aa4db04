"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes is computed at every byte; a chunk ends where the hash is
the strict maximum of the REACH bytes before and not below the REACH bytes after. Cuts thus depend on
nearby content alone, and an insertion moves no cut beyond its neighbourhood. Chunks (49 bytes on
average) are deduplicated by a 128-bit digest: of equal chunks the one in the document with the smallest
id stays, first occurrence. Adjacent duplicate chunks are joined to spans, and a span of MIN_WORDS words
or more is reported. What lies between a passage's ends and the first and last cut inside it isn't matched, about 80 bytes
on each side at most times, so nearly all repeated passages of over 50 words hold such a span (how many, by the length
of words, is in the README), a common short line doesn't.

Defined results: a null text is an empty text and has no chunks; rows are told apart by place, so rows with the same id or
a null id are deduplicated like others (of a chunk in several rows with the least id, or with null ids alone, one row's stays); periodic
text has few cuts and so long chunks; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.kernels import char_offsets, mix, slices, texts
from lorewell.llm.shared import Scratch, narrow_batches, table

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
WINDOW, REACH, MIN_WORDS = 32, 24, 12


def cut_ends(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted ends (exclusive) of all chunks of all documents."""
    n = len(buf)
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):  # after each step h covers the last 2k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if n > k else h[k:]
    high = h.copy()  # high[i]: the maximum of h[i : i + 16], then of h[i : i + REACH]
    for k in (1, 2, 4, 8):
        if n > k:
            np.maximum(high[:-k], high[k:], out=high[:-k])
    if n > 8:
        high[:-8] = np.maximum(high[:-8], high[8:])
    at = np.zeros(n, bool)
    if n > 2 * REACH:
        mid = slice(REACH, n - REACH)
        at[mid] = (h[mid] > high[: n - 2 * REACH]) & (h[mid] >= high[REACH + 1 : n - REACH + 1])
    ends = np.flatnonzero(at) + 1
    doc = np.searchsorted(offs, ends - 1, "right") - 1
    inside = (ends - 1 - offs[doc] >= WINDOW + REACH) & (offs[doc + 1] - ends >= REACH)
    return np.unique(np.concatenate((ends[inside], offs[1:][np.diff(offs) > 0])))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf_all, offs_all = texts(b.column(2))
        for i, j in slices(offs_all):
            buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
            ends = cut_ends(buf, offs)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
            doc = np.searchsorted(offs, starts, "right") - 1
            raw = buf.tobytes()
            both = np.frombuffer(b"".join([hashlib.blake2b(raw[p:q], digest_size=16).digest() for p, q in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            again = np.zeros(len(ends), bool)
            order = np.lexsort((starts, both[:, 1], both[:, 0], doc))
            o = both[order]
            again[order[1:]] = (o[1:] == o[:-1]).all(1) & (doc[order[1:]] == doc[order[:-1]])
            space = (buf == 32) | ((buf >= 9) & (buf <= 13))
            word = ~space
            word[1:] &= space[:-1]
            word[offs[:-1][np.diff(offs) > 0]] |= ~space[offs[:-1][np.diff(offs) > 0]]
            w = np.concatenate(([0], np.cumsum(word)))
            c = char_offsets(buf)
            of = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(of), b.column(1).take(of), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(c[starts] - c[offs[doc]]), pa.array(c[ends] - c[offs[doc]]), pa.array((w[ends] - w[starts]).astype(np.int32)), pa.array(again),
                ],
                ["_k", "doc_id", "d1", "d2", "start", "end", "words", "again"],
            )


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k (the row), doc_id, d1, d2 (digest), start, end (code points), words (that begin in it), again (occurred before in this row)."""
    narrow_batches(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("_k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_chunked, "_k long, doc_id long, d1 long, d2 long, start long, end long, words int, again boolean")


def repeated_spans(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_ids): spans that deduplication takes out, and where they stay (ids that are not null)."""
    found = scratch.save(chunks(docs, id_col, text_col))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    repeated = found.groupBy("d1", "d2").agg(F.count("*").alias("_n"), F.min("doc_id").alias("first_doc_id"), F.min_by("_k", last).alias("_first"))
    # written first, so that both sides of the join are plain exchanges, whose large keys (a chunk that very many documents share) can be split
    repeated = scratch.save(repeated.where("_n > 1").drop("_n"))
    drop = found.join(repeated, ["d1", "d2"]).where(F.col("again") | (F.col("_k") != F.col("_first")))
    place = W.partitionBy("_k").orderBy("start", "end")
    drop = drop.withColumn("_new", F.coalesce((F.lag("end").over(place) < F.col("start")).cast("int"), F.lit(1)))
    drop = drop.withColumn("_span", F.sum("_new").over(place.rowsBetween(W.unboundedPreceding, 0)))
    spans = drop.groupBy("_k", "_span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
        F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )
    return spans.where(F.col("n_words") >= min_words).drop("_k", "_span")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(Scratch(spark, "op1"), table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
