"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New data are reduced to one row per
digest, anti-joined with the index by sort-merge on its buckets, and what is new is appended; each
document then looks its digest up. Runs of white space count as one space.

Defined results: a null text is an empty text, and all empty texts are one group; of rows with the
same digest the smallest id stays (null ids only if there is no other), and of repeated ids every
row is reported and the row that stays is told by id alone; an empty table gives no rows; other
columns of the input are not read. Digests that an earlier batch brought keep that batch's row.

Each append adds a file to each bucket; ``compact`` makes one sorted file of them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import Scratch, lookup, null_to_empty, table

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(null_to_empty(text), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text, 32 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)).alias("digest"))


class DigestIndex:
    """(digest, keep_id) in ``buckets`` buckets, at ``path``; the same path opened again is the same index."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Append those of ``groups`` (digest, keep_id; a row per digest) that the index lacks."""
        known = self.table().select("digest").hint("merge")
        fresh = groups.select("digest", "keep_id").join(known, "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def compact(self, scratch: Scratch) -> None:
        """Rewrite the index with one sorted file per bucket, by way of a written copy."""
        copy = scratch.save(self.table())
        (copy.repartition(self.buckets, "digest").write.format("parquet").mode("overwrite")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)
        scratch.drop(copy)

    def forget(self) -> None:
        """Take the name out of the catalogue; the index at its path stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row, after appending its new digests to ``index``.

    group_size counts the rows of this batch. Texts are read once: the digests are written first.
    """
    own = scratch.save(digests(docs, id_col, text_col))
    groups = scratch.save(own.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    index.append_new(groups)
    kept = scratch.save(groups.drop("keep_id").join(index.table().hint("merge"), "digest"))
    out = lookup(own, kept, "digest", "group_size")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "op5")
    index = DigestIndex(spark, f"{scratch.path}/index", "digest_index_" + scratch.path.rsplit("-", 1)[1], 32)
    out = dedup(docs, index, scratch)
    index.forget()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}

ORACLES = {
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
}
