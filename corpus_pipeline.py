"""From raw documents to training shards: quality, near duplicates, contamination, mix, shards.

Each stage takes what its predecessor kept, with the columns of documents, and its decisions take effect:
the first four drop documents, the last adds cell, shard and slot. Columns that documents have besides are kept.
Every decision is about a row, told by its place and not by its id, so null and repeated ids lose or keep no other row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import decontamination, mixing, near_dedup, quality, sharding
from lorewell.llm.shared import ROW, Scratch, keyed, table

#: The mix takes this share of all words, without repeats.
SHARE, SHARDS = 0.9, 16


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; each is judged by its text alone, empty and null texts go."""
    return quality.accepted(Scratch(spark, "pipeline-quality"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more): one with the least id, nulls last, and of several the first."""
    scratch = Scratch(spark, "pipeline-near")
    docs = keyed(scratch, docs)
    groups = near_dedup.near_duplicates(scratch, docs, k=5)
    return docs.join(near_dedup.dropped(groups), ROW, "left_anti").drop(ROW)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no copy, edited or not, of a benchmark item, whatever their ids."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes; one that is cut at the end stays if half of it or more is taken. Rows without words go: the mix takes none of them."""
    scratch = Scratch(spark, "pipeline-mix")
    docs = keyed(scratch, docs)
    rows, services = mixing.mix(scratch, docs, SHARE, cap=1)
    words = services.groupBy("_row").agg(F.sum("words").alias("_words"))
    taken = rows.join(words, "_row").where(F.col("_words") * 2 >= F.col("size"))
    return docs.join(taken.select(ROW), ROW, "left_semi").drop(ROW)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in shards along the Hilbert curve."""
    return sharding.shard(Scratch(spark, "pipeline-shards"), docs, SHARDS, docs.columns)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", uncontaminated),
    ("mixing to target weights", mixed),
    ("Hilbert sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, which cuts lineage."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is trained, so SQL can't express its stage; the stages are tested against brute force.
ORACLE_SQL = None
