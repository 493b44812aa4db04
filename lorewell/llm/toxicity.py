"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents, each on its own class. The ordinary one is trained on
ordinary documents. Toxic documents are mostly ordinary text too, and two dictionaries that are trained on
whole documents differ by chance more than by class; so the toxic one is trained on the passages of toxic documents whose
byte strings are in far more of them than of ordinary ones, and every such passage that the trainer left out stands behind
what it picked, the commonest last: none is cut for room, so habits of a language with few toxic documents stay. Toxic text
is then modelled as ordinary text with such passages: every document is cut into overlapping windows of WINDOW bytes at word starts, each window is compressed
with the ordinary dictionary's content and with that of both, and the difference of the two lengths tells how much
better the toxic class explains it. A logistic curve over a document's differences (largest, mean of the largest three,
mean, numbers and shares of windows above thresholds), fitted on training documents kept apart, calibrates the score.

Only labelled documents whose crc32 of the id as text is not 2 modulo 4 are learnt from, at most SAMPLE
per class (of those with texts of up to SAMPLE_BYTES, the ones with the smallest hash of the id); id, source, language and
labels are no inputs of a score.

Defined results: a null text is an empty text; an empty text has no window and gets the score of a document
whose differences are all zero; without labels of both classes every score is 0.5; repeated rows are scored
again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import narrow_batches, table

SAMPLE, SAMPLE_BYTES = 3000, 32768
WINDOW, STRIDE = 64, 40
#: Bytes that the trainer picks for the ordinary and the toxic dictionary, and bytes of its segments; bytes of a telling string.
ORDINARY, TOXIC, GRAM = (16 << 10, 48), (1 << 10, 32), 7
HELD_OUT, THRESHOLD = 2, 0.3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain(text: str | None) -> bytes:
    """Lower-cased words, one space between them."""
    return b" ".join(_WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER)))


def windows(words: bytes) -> list[bytes]:
    """Windows of about WINDOW bytes that begin at words, one each STRIDE bytes or less often; they cover the whole text."""
    out, at, n = [], 0, len(words)
    while at < n:
        out.append(words[at : at + WINDOW])
        if at + WINDOW >= n:
            break
        nxt = words.find(b" ", at + STRIDE, at + WINDOW)
        at = nxt + 1 if nxt >= 0 else at + STRIDE
    return out


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(3, window_log=20, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)


# How a trained dictionary begins, and the three start offsets that end its header.
MAGIC, STARTS = bytes.fromhex("37a430ec"), bytes.fromhex("010000000400000008000000")


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on ``samples``, without its header; the samples themselves where they are too few to train on."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]
    at = whole.find(STARTS)
    return whole[at + len(STARTS) :] if whole.startswith(MAGIC) and at >= 0 else whole


def with_all(content: bytes, passages: list[bytes]) -> bytes:
    """A dictionary's content and, behind it, each distinct part of ``passages``, the most frequent last."""
    counts = Counter(part for p in passages for part in p.split())
    return b" ".join([content, *(part for part, _ in sorted(counts.items(), key=lambda x: (x[1], x[0])))])


class Model:
    """Both dictionaries' contents, the window threshold, and the curve's weights."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.above, self.center, self.scale, self.weights = 0.0, np.zeros(7), np.ones(7), np.zeros(8)
        self._compress: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compress": None}

    def differences(self, words: bytes) -> np.ndarray:
        if self._compress is None:
            raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.ordinary, self.toxic + self.ordinary)]
            self._compress = tuple(zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters()).compress for d in raw)
        ordinary, toxic = self._compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words)], float)

    def summary(self, d: np.ndarray) -> np.ndarray:
        if not len(d):
            return np.zeros(7)
        top, over = np.sort(d)[-3:], (d >= self.above).sum()
        return np.array([top[-1], top.mean(), np.log1p(over), over / len(d), d.mean(), (d >= 2).mean(), (d >= 4).mean()])

    def features(self, words: bytes) -> np.ndarray:
        return self.summary(self.differences(words))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return 1 / (1 + np.exp(-(self.weights[0] + z @ self.weights[1:])))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(words: bytes) -> np.ndarray:
    """The GRAM-byte strings at every place of ``words``, as numbers."""
    b = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.int64)
    n = len(b) - GRAM + 1
    return sum((b[k : n + k] << (8 * k) for k in range(GRAM)), np.zeros(max(n, 0), np.int64)) if n > 0 else np.zeros(0, np.int64)


def _counted(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings and in how many documents each is."""
    return np.unique(np.concatenate([np.unique(_grams(d)) for d in docs] + [np.zeros(0, np.int64)]), return_counts=True)


def without_copies(docs: list[bytes], most: float = 0.3, gram: int = 16) -> list[bytes]:
    """``docs`` without those that share over ``most`` of their ``gram``-byte strings with earlier ones: a copied passage is no habit of a class."""
    seen, out = set(), []
    for d in docs:
        own = {d[k : k + gram] for k in range(0, max(1, len(d) - gram + 1))}
        own = {g for g in own if zlib.crc32(g) % 4 == 0}
        if len(own & seen) <= most * len(own):
            out.append(d)
        seen |= own
    return out


def telling(docs: list[bytes], other: list[bytes], lift: float = 4.0, least: int = 4, surprise: float = 16.0) -> list[bytes]:
    """Of each of ``docs`` the parts whose strings are in ``lift`` times as many of them as of ``other``, by more than chance; without documents that have none.

    Chance is told by the log-likelihood ratio, which is over 16 for one string in 16,000.

    A string must also follow ``least`` different texts or more, which tells a habit from a copied passage.
    """
    g, n = _counted(docs)
    h, m = _counted(other)
    there = np.zeros(len(g), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, g), len(h) - 1)
        there[h[at] == g] = m[at[h[at] == g]]
    share, both = len(docs) / (len(docs) + len(other)), n + there
    ratio = 2 * (n * np.log(n / (both * share)) + there * np.log(np.maximum(there, 1) / (both * (1 - share))))
    good = g[(n >= least) & (ratio >= surprise) & ((n + 0.5) / (len(docs) + 1) >= lift * (there + 0.5) / (len(other) + 1))]
    if not len(good):
        return []
    marks, pairs = [], []
    for d in docs:
        own = _grams(d)
        hit = good[np.minimum(np.searchsorted(good, own), len(good) - 1)] == own
        at = np.flatnonzero(hit)
        marks.append(hit)
        before = np.where(at >= GRAM, own[np.maximum(at - GRAM, 0)], -1 - at)
        pairs.append(np.column_stack([own[at], before]))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    g, n = np.unique(pairs[:, 0], return_counts=True)
    good = g[n >= least]
    many = n[n >= least]
    out = []
    for d in docs:
        own, text = _grams(d), b" " + d + b" "
        at = np.minimum(np.searchsorted(good, own), max(len(good) - 1, 0))
        seen = np.where(good[at] == own, many[at], 0) if len(good) else np.zeros(len(own), np.int64)
        edge = np.diff(np.concatenate(([0], seen > 0, [0])))
        parts = []
        for p, q in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            core = np.flatnonzero(seen[p:q] * 2 >= seen[p:q].max())  # without what merely stands beside it now and then
            parts.append(text[p + core[0] : p + core[-1] + GRAM])
        if parts:
            out.append(b"".join(parts))
    return out


def fit(rows: list[tuple[int, str | None]]) -> Model | None:
    """rows: (toxic, text). Half of the documents train the dictionaries, the other half the curve."""
    half = [(t, plain(s)) for t, s in rows]
    half = [(t, s, zlib.crc32(s) % 2) for t, s in half]
    ordinary, toxic = ([s for t, s, h in half if t == c and h == 0] for c in (0, 1))
    if not ordinary or not toxic or len({t for t, _, h in half if h}) < 2:
        return None
    passages = telling(without_copies(toxic), ordinary)
    model = Model(with_all(trained(passages, *TOXIC), passages), trained(ordinary, *ORDINARY))
    rest = [(t, s) for t, s, h in half if h]
    y = np.array([t for t, _ in rest], float)
    diffs = [model.differences(s) for _, s in rest]
    calm = np.concatenate([d for d, t in zip(diffs, y, strict=True) if not t])
    model.above = float(np.quantile(calm, 0.998)) + 1 if len(calm) else 1.0
    x = np.array([model.summary(d) for d in diffs])
    model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.center) / model.scale, y)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, str | None]]:
    """At most ``sample`` labelled rows of each class, none of them held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    known = known.join(short.select("doc_id").distinct(), "doc_id")
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    some = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    own = short.select("doc_id", F.col("text").cast("string").alias("text"))
    one = own.join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return [(r.toxic, r.text) for r in sorted(one.collect(), key=lambda r: r.doc_id)]  # 2 * sample rows at most


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model and b.num_rows:
                scores = model.scores(np.array([model.features(plain(s)) for s in b.column(2).to_pylist()]))
            else:
                scores = np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    narrow_batches(docs.sparkSession)
    model = fit(training_rows(docs, labels))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
