"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The votes' patterns are counted over
the whole corpus (at most 3 to the number of labellers patterns), and expectation-maximisation over these
counts estimates each labeller's accuracy and the share of good documents, without any gold label.
The patterns' posterior labels then train a linear scorer on hashed byte trigrams and word repeats, on a sample of at most
SAMPLE documents: half of them from the patterns that are rather bad and half from the others, as far as there are so many,
weighted back to their shares of all documents. However rare bad documents are, the sample holds them. The scorer judges every document.

Defined results: a null text is an empty text; an empty text has score 0 and is rejected; ids are not
read; repeated rows are judged alike; an empty table gives no rows; if no labeller ever
votes against a document, all non-empty ones are kept; if EM calls all patterns bad, all are rejected with score 0; other columns,
whatever their names, are passed through by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lorewell.llm.kernels import SPACED, Words, slices, spread, texts
from lorewell.llm.shared import ROW, Scratch, col, keyed, narrow_batches, table

SAMPLE, DIM, REJECT = 3000, 4096, 0.4
#: Trigrams without weight that every document has besides its own, so that few of its own decide little.
CALM = 400
GOOD, BAD, NONE = 2, 1, 0
#: The scorer where every pattern is bad: no text changes what the constant says.
ALL_BAD = np.append(np.zeros(DIM + 1), -np.inf)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_SYMBOL = np.array([chr(b) in "#$%&*<>{}[]\\^~=_+@`/" for b in range(256)])


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags)))
    return c[offs[1:]] - c[offs[:-1]]


def votes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One column of votes per labeller."""
    w = Words(buf, offs, SPACED)
    n = np.diff(w.first)
    size, some = np.maximum(np.diff(offs), 1), np.maximum(n, 1)
    short = _sums((w.end - w.start) <= 3, w.first)
    cased = np.maximum(_sums(_UPPER[buf] | _LOWER[buf], offs), 1)
    upper = _sums(_UPPER[buf], offs) / cased
    tail = np.zeros(len(w.end), bool)
    if len(w.end):
        tail = _SYMBOL[buf[w.end - 1]]
    loud = np.zeros(len(w.end), bool)
    if len(w.end):
        loud = buf[w.end - 1] == ord("!")
    bars = _sums(buf == ord("|"), offs) / some
    ends = _sums((buf == ord(".")) | (buf == ord("?")), offs) / some
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w.hash, of))
    doc, sorted_hash = of[order], w.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (doc[1:] != doc[:-1])
    distinct = np.bincount(doc[new], minlength=len(n)) / some
    again = np.zeros(len(of), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of[again], minlength=len(n)) / some
    symbols = (_sums(_SYMBOL[buf], offs) + _sums(buf == ord("|"), offs)) / size
    tails, louds = _sums(tail, w.first) / some, _sums(loud, w.first) / some
    plain = _sums(((w.end - w.start) <= 3) & ~_SYMBOL[buf[w.start]] & (buf[w.start] != ord("|")), w.first) / some if len(w.end) else short / some
    long = n > 20

    def vote(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    return np.column_stack([
        vote(symbols > 0.05),
        vote(tails > 0.25),
        vote((upper > 0.5) & long),
        vote((louds > 0.25) & long),
        vote((bars > 0.15) & long),
        vote((plain < 0.08) & long, (plain > 0.15) & (plain < 0.6) & long),
        vote((again > 0.2) & long),
        vote((distinct < 0.12) & (n > 60), (distinct > 0.25) & long),
        vote(((ends < 0.005) | (ends > 0.8)) & (n > 40), (ends > 0.02) & (ends < 0.4) & long),
    ])


def em(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's P(vote | bad or good), and the share of good documents.

    Conditionally independent votes with three outcomes; the start doubts what any labeller votes against, and smoothing keeps
    a labeller that never votes neutral.
    """
    n = patterns.shape[1]
    post = np.where((patterns == BAD).any(1), 0.1, 0.9)
    chance, prior = np.zeros((2, n, 3)), 0.9
    for _ in range(steps):
        share = np.vstack([1 - post, post]) * counts
        prior = (share[1].sum() + 1) / (counts.sum() + 2)
        for v in range(3):
            chance[:, :, v] = share @ (patterns == v) + 0.5
        chance /= chance.sum(2, keepdims=True)
        like = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(chance[:, k, :])[:, patterns[:, k]] for k in range(n))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, chance, prior


def _code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all documents, the n + 1 offsets into them, and the bytes of words that repeat the one before."""
    n = np.maximum(np.diff(offs) - 2, 0)
    at = spread(offs[:-1], n)
    b = buf.astype(np.uint32)
    h = ((b[at] * np.uint32(0x9E3779B1) ^ b[at + 1] * np.uint32(0x85EBCA6B) ^ b[at + 2] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(33 - DIM.bit_length())
    w = Words(buf, offs, SPACED)
    of = np.repeat(np.arange(len(n)), np.diff(w.first))
    again = np.zeros(len(of), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    return h.astype(np.int64), np.concatenate(([0], np.cumsum(n))), np.bincount(of, again * (w.end - w.start), minlength=len(n))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = texts(b.column(1))
        for i, j in slices(offs):
            code = _code(votes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(code)], [ROW, "pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its trigrams that occur and how often, its repeated bytes and its number of trigrams."""
    for b in batches:
        buf, offs = texts(b.column(1))
        for i, j in slices(offs):
            h, first, again = _hashed(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            cells, counts = [], []
            for p, q in zip(first[:-1], first[1:], strict=True):
                c, n = np.unique(h[p:q], return_counts=True)
                cells.append(c.astype(np.uint16).tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(cells, pa.binary()), pa.array(counts, pa.binary()), pa.array(again.astype(np.float64)), pa.array(np.diff(first))], ["pattern", "cells", "counts", "again", "n"]
            )


def _train(rows: list[tuple[np.ndarray, np.ndarray, float, int]], y: np.ndarray, weight: np.ndarray, steps: int = 600, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent. The constant comes last.

    ``rows``: cells, counts, repeated bytes and number of trigrams of each document. Rows without evidence pull the constant to the side of good.
    """
    blank = max(1, len(rows) // 20)
    z = np.zeros((len(rows) + blank, DIM + 2), np.float32)
    for k, (cells, counts, again, n) in enumerate(rows):
        z[k, cells] = counts / (n + CALM)
        z[k, DIM] = again / (n + CALM)
    y, weight = np.append(y, np.full(blank, 0.95)), np.append(weight, np.ones(blank))
    weight /= weight.mean()
    scale = 1 / np.maximum(np.sqrt(weight @ np.square(z[:, :-1]) / len(z)), 2e-4)
    scale[-1] *= 8  # repeats are one column among thousands
    z[:, :-1] *= scale.astype(np.float32)
    z[:, -1] = 1
    rate = 4 / (weight @ np.square(np.linalg.norm(z, axis=1)) / len(z))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    for k in range(steps):
        ahead = w + np.float32(k / (k + 3)) * (w - v)
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        v, w = w, ahead - np.float32(rate) * ((weight * (p - y)) @ z / np.float32(len(z)) + np.float32(ridge) * ahead)
    return np.concatenate([w[:-1] * scale, w[-1:]]).astype(np.float64)


def fit(scratch: Scratch, docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's DIM + 1 weights and constant; None where the labellers find no bad document."""
    narrow_batches(docs.sparkSession)
    own = keyed(scratch, docs.select(F.col(text_col).cast("string").alias("text"))).select(ROW, "text")
    voted = scratch.save(own.mapInArrow(_voted, f"{ROW} struct<f: long, i: long>, pattern int"))
    counted = voted.groupBy("pattern").count().collect()  # 3^9 rows at most
    if not counted:
        return None
    n = 9
    code, counts = np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted], float)
    order = np.argsort(code)
    code, counts = code[order], counts[order]
    post, _, _ = em(code[:, None] // 3 ** np.arange(n) % 3, counts)
    bad = post < 0.5
    if not bad.any():
        return None
    if bad.all():
        return ALL_BAD
    few = int(min(counts[bad].sum(), max(sample // 2, sample - counts[~bad].sum())))
    known = F.col("pattern").isin([int(c) for c in code[bad]])
    order = [F.xxhash64(F.lit("quality"), f"{ROW}.i"), ROW]
    picked = voted.where(known).orderBy(*order).limit(few).union(voted.where(~known).orderBy(*order).limit(sample - few))
    rows = own.join(F.broadcast(picked), ROW).select("pattern", "text")  # ``sample`` keys at most
    rows = rows.mapInArrow(_featured, "pattern int, cells binary, counts binary, again double, n long").collect()
    rows.sort(key=lambda r: (r.pattern, r.n, r.again, bytes(r.cells), bytes(r.counts)))  # they come in any order
    at = np.searchsorted(code, np.array([r.pattern for r in rows]))
    held = np.bincount(bad[at].astype(int), minlength=2)
    weight = np.where(bad[at], counts[bad].sum() / max(held[1], 1), counts[~bad].sum() / max(held[0], 1))
    return _train([(np.frombuffer(r.cells, np.uint16), np.frombuffer(r.counts, np.uint32), r.again, r.n) for r in rows], post[at], weight)


def _judged(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    if weights is None:
        return np.where(np.diff(offs) > 0, 1.0, 0.0)
    if weights[-1] == -np.inf:
        return np.zeros(len(offs) - 1)
    out = [np.zeros(0)]
    for i, j in slices(offs):
        own = offs[i : j + 1] - offs[i]
        h, first, again = _hashed(buf[offs[i] : offs[j]], own)
        c = np.concatenate(([0.0], np.cumsum(weights[h])))
        s = 1 / (1 + np.exp(-np.clip((c[first[1:]] - c[first[:-1]] + again * weights[DIM]) / (np.diff(first) + CALM) + weights[-1], -50, 50)))
        out.append(np.where(np.diff(own) > 0, s, 0.0))
    return np.concatenate(out)


def _scored(weights: np.ndarray | None, text: int, least: float | None):
    """The score beside the one struct column; without the rows below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = _judged(*texts(b.column(0).flatten()[text]), weights)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["row", "score"])
            yield out if least is None else out.filter(pa.array(score >= least))

    return run


def _judged_rows(scratch: Scratch, docs: DataFrame, keep: list[str], text_col: str, least: float | None) -> DataFrame:
    """(row, score): the ``keep`` columns as a struct, of every row or of those that reach ``least``."""
    weights = fit(scratch := scratch.inner(), docs, text_col)
    held = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    rows = docs.select(F.struct(*map(col, keep), *([] if held else [col(text_col).cast("string").alias("_text")])).alias("row"))
    at = keep.index(text_col) if held else len(keep)
    out = rows.mapInArrow(_scored(weights, at, least), StructType(list(rows.schema.fields)).add("score", DoubleType()))
    scratch.only()
    return out


def scored(scratch: Scratch, docs: DataFrame, keep: list[str], text_col: str = "text", least: float | None = None) -> DataFrame:
    """``keep`` columns of every row (of those that reach ``least``), and score (0 to 1, higher: better)."""
    return _judged_rows(scratch, docs, keep, text_col, least).select(*[F.col("row")[c].alias(c) for c in keep], "score")


def accepted(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The documents that the scorer does not reject, with all their columns."""
    return _judged_rows(scratch, docs, docs.columns, "text", REJECT).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(Scratch(spark, "op9"), table(spark, sf_dir, "documents"), ["doc_id"])
    return out.withColumn("kept", F.col("score") >= REJECT)


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
