"""Grouping of spelling variants without pairs.

Words that differ by one replaced letter share a wildcard group (position, prefix, suffix); a word's groups keep their size
and their two best words, so a word counts its neighbours and finds the best one besides itself without meeting any of them.
Words that differ by an inserted or deleted letter meet where a deletion of the longer one is in the vocabulary. Both kinds
of group are made by one shuffle of (group, place of the word in the order of n and letters): place 0 is the best word, so
the best neighbour is the least place, and no text but the group's key is moved. A group has as many members as there are
letters (wildcards), or as there are letters at all places of a word (deletions), whatever the data.

Groups of words over LONG letters are keyed by their length, position and running hashes modulo a prime of 127 bits,
since the keys of a word would else take the square of its length.

Defined results: null and empty texts have no words; a null id is written as no digits where ids decide what is deleted;
repeated rows count again; a word with equally good neighbours takes the first in code-point order; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.shared import Scratch, narrow_batches, null_to_empty, range_sorted, table

#: A word has at least so many letters and occurrences; one run in ONE_IN, by its document and letters, loses a letter.
LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
#: Words up to LONG letters have their groups' keys spelled out.
LONG = 48
#: Code points of a text that are worked on at a time, and distinct words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_SMALL = {c: c + 32 for c in range(65, 91)}
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A5


def _pieces(text: str) -> Iterator[str]:
    """Pieces that end where no letter stands."""
    a = 0
    while a < len(text):
        m = _NO_LETTER.search(text, a + PIECE)
        b = m.end() if m else len(text)
        yield text[a:b]
        a = b


def _noisy(doc_id: str, runs: Counter) -> Iterator[tuple[str, int]]:
    """Each run of the document with its count, less one letter where the hash of id and run says so."""
    head = crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = crc32(run.encode(), head)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of each word over all whole texts. Tasks count before the shuffle."""
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                doc, runs = i.as_py(), Counter()
                for piece in _pieces(t.as_py()):
                    runs.update(_RUN.findall(piece.translate(_SMALL) if not piece.isascii() else piece.lower()))
                for w, n in _noisy(doc, runs):
                    held[w] += n
                if len(held) > HELD:
                    yield from _rows(held)
                    held = Counter()
        yield from _rows(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), null_to_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rows(held: Counter, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    words, n = list(held), list(held.values())
    for a in range(0, len(words), size):
        yield pa.RecordBatch.from_arrays([pa.array(words[a : a + size], pa.string()), pa.array(n[a : a + size], pa.int64())], names=["word", "n"])


#: Kinds of a word's membership in a group: by a wildcard, as the word itself, by a deletion.
WILD, SELF, DELETED = 0, 1, 2


def _spelled_keys() -> Column:
    """(key, kind) of a word up to LONG letters; equal deletions count once."""
    places = "sequence(1, length(word))"
    wild = f"transform({places}, i -> struct(concat(substring(word, 1, i - 1), '*', substring(word, i + 1)) AS key, {WILD} AS kind))"
    gone = f"transform(array_distinct(transform({places}, i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))), k -> struct(k AS key, {DELETED} AS kind))"
    return F.expr(f"concat({wild}, {gone}, array(struct(word AS key, {SELF} AS kind)))")


def _hashed(word: str) -> Iterator[tuple[str, int]]:
    """(key, kind) of a word of LONG letters or more. Hashes read from the left and from the right, so that one without a letter is put together from two."""
    letters, n, p, base = [ord(c) for c in word], len(word), _PRIME, _BASE
    left = [0]  # of the first i letters: sum of letter * base^place
    power = [1]
    for c in letters:
        left.append((left[-1] + c * power[-1]) % p)
        power.append(power[-1] * base % p)
    right = [0] * (n + 1)  # of the letters from i on, the first of them at place 0
    for i in range(n - 1, -1, -1):
        right[i] = (letters[i] + base * right[i + 1]) % p
    yield f"#{n}:{left[n]:x}", SELF
    seen = set()
    for i in range(n):
        yield f"*{n}:{i}:{(left[i] + power[i + 1] * right[i + 1]) % p:x}", WILD
        gone = (left[i] + power[i] * right[i + 1]) % p
        if gone not in seen:
            seen.add(gone)
            yield f"#{n - 1}:{gone:x}", DELETED


def _hashed_keys(words: DataFrame) -> DataFrame:
    """(key, kind, at) of words of LONG letters or more; of those with LONG letters only themselves, for longer ones to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for w, at in zip(b.column(0), b.column(1), strict=True):
                word, at = w.as_py(), at.as_py()
                for key, kind in _hashed(word):
                    if len(word) > LONG or kind == SELF:
                        held.append((key, kind, at))
                    if len(held) >= 20_000:
                        yield _keys(held)
                        held = []
        if held:
            yield _keys(held)

    return words.where(F.length("word") >= LONG).select("word", "at").mapInArrow(run, "key string, kind int, at long")


def _keys(held: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=["key", "kind", "at"])


def _met(keys: DataFrame) -> DataFrame:
    """(at, n_near, best): how many words each word meets in its groups, and the least place of them.

    One sort by (key, place) serves all that is asked of a group: its first two wildcards, its first deletion, the word itself.
    """
    group = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wild, itself, gone = (F.col("kind") == k for k in (WILD, SELF, DELETED))
    members = keys.select(
        "at", "kind", F.count("*").over(group).alias("size"), F.first("at").over(group).alias("one"), F.nth_value("at", 2).over(group).alias("two"),
        F.max(F.when(itself, F.col("at"))).over(group).alias("word"), F.min(F.when(gone, F.col("at"))).over(group).alias("longer"),
    )
    others = F.when(itself | wild, F.col("size") - 1).otherwise(1)
    best = F.when(wild, F.when(F.col("at") == F.col("one"), F.col("two")).otherwise(F.col("one"))).when(itself, F.col("longer")).otherwise(F.col("word"))
    met = members.where((F.col("size") > 1) & (wild | F.col("word").isNotNull())).select("at", others.alias("others"), best.alias("best"))
    return met.groupBy("at").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def variants(scratch: Scratch, counted: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n).

    A form has twice the word's n at least, so chains are short: the roots are found by going from form to form's form,
    which halves what is left of a chain each time.
    """
    words = scratch.save(range_sorted(scratch, counted.withColumn("_less", -F.col("n")), ["_less", "word"]).select("word", "n", F.col("_pos").alias("at")))
    short = words.where(F.length("word") <= LONG)
    keys = short.select(F.explode(_spelled_keys()).alias("k"), "at").select("k.key", "k.kind", "at").unionByName(_hashed_keys(words))
    met = scratch.save(_met(keys))
    other = words.select(F.col("at").alias("best"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = words.join(met, "at", "left").join(other, "best", "left")
    has = F.col("other_n") >= 2 * F.col("n")
    rows = scratch.save(
        found.select("at", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(has, F.col(c)).alias(a) for c, a in (("best", "next"), ("other", "form"), ("other_n", "form_n"))])
    )
    links = rows.where(F.col("next").isNotNull()).select("at", "next")
    while True:
        links = scratch.save(links)
        on = links.select(F.col("at").alias("next"), F.col("next").alias("further"))
        longer = links.join(on, "next", "left")
        if longer.where(F.col("further").isNotNull()).isEmpty():
            break
        links = longer.select("at", F.coalesce("further", "next").alias("next"))
    roots = links.join(words.select(F.col("at").alias("next"), F.col("word").alias("root")), "next").select("at", "root")
    out = rows.join(roots, "at", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    counted = scratch.save(counts(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST_COUNT))
    return variants(scratch, counted)


QUERIES = {"op12_spelling": op12_spelling}

ORACLES = {
    "op12_spelling": r"""
WITH RECURSIVE bits AS (
  SELECT list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v, i
  FROM (SELECT unnest(range(256)) AS i)
), crcs AS (
  SELECT list(v ORDER BY i) AS t FROM bits
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT run, n, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b FROM runs
), hashed AS (
  SELECT run, n, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS h FROM bytes, crcs
), noisy AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), wild AS (
  SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), gone AS (
  SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.key = w.word
  UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.key = w.word
), best AS (
  SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), up AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, u.root FROM forms f JOIN up u ON f.form = u.word
)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM forms f JOIN up u USING (word)
"""
}
