"""A cache of vectors by (body_hash, model): conflicts, age, and eviction of the least recently used by bytes.

Entries are (body_hash, model, vector, created_ms, used_ms). Eviction keeps the entries used last whose bytes fit: a running sum over
a sort by ranges, so the cache may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.runtime import running

#: Bytes that a cache holds unless told otherwise.
MAX_BYTES = 32 << 20


def entry_bytes() -> Column:
    """Four bytes for each number of the vector, and the model's name."""
    return (F.size("vector") * 4 + F.octet_length("model")).cast("long")


def merged(cache: DataFrame, incoming: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One entry per key: the one made later, then the larger vector; it was last used when any of them was. Entries that can't fit stay out."""
    rows = cache.unionByName(incoming.where(entry_bytes() <= max_bytes))
    best = rows.groupBy("body_hash", "model").agg(F.max(F.struct("created_ms", "vector")).alias("x"), F.max("used_ms").alias("used_ms"))
    return best.select("body_hash", "model", "x.vector", "x.created_ms", "used_ms")


def unexpired(cache: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Entries not older than ``ttl_ms``; all of them where it is not above 0."""
    return cache.where(F.lit(now_ms) - F.col("created_ms") <= ttl_ms) if ttl_ms > 0 else cache


def fitting(cache: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The entries used last whose bytes are ``max_bytes`` at most; of those used at the same time the first keys."""
    rows = running(cache.withColumn("_bytes", entry_bytes()), "_bytes", F.desc("used_ms"), "body_hash", "model")
    return rows.where(F.col("before") + F.col("_bytes") <= max_bytes).select(*cache.columns)


def used(cache: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """The cache after the keys (body_hash, model) of ``wanted`` were asked for: those that it has were used now."""
    asked = wanted.select("body_hash", "model").distinct().withColumn("_asked", F.lit(True))
    rows = cache.join(asked, ["body_hash", "model"], "left")
    return rows.withColumn("used_ms", F.when(F.col("_asked"), F.greatest("used_ms", F.lit(now_ms))).otherwise(F.col("used_ms"))).select(*cache.columns)
