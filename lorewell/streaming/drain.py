"""Draining the queue of notes that need a vector, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.functions.runtime import ship
from lorewell.functions.vectors import embedder
from lorewell.operators.semantic import embedding_state

MAX_PENDING = 1000


def embedding_text(prefix: bool = False) -> Column:
    """What is embedded of a note: statement and body, or with the prefix that some models want."""
    if prefix:
        return F.concat(F.lit("title: "), F.col("statement"), F.lit(" | text: "), F.coalesce("body", F.lit("")))
    return F.when(F.trim("body") == "", F.col("statement")).otherwise(F.concat_ws("\n", "statement", "body"))


def pending(notes: DataFrame, index: DataFrame) -> DataFrame:
    """Notes without a vector of their present text."""
    state = embedding_state(notes, index).where("state <> 'indexed'")
    return notes.join(state, "id")


def backpressure(waiting: DataFrame, most: int = MAX_PENDING) -> bool:
    """Whether more notes wait than should."""
    return waiting.limit(most + 1).count() > most


def drained(waiting: DataFrame, embed: Callable = embedder) -> DataFrame:
    """(id, body_hash, vector); notes whose vector fails stay away and so stay pending."""
    return waiting.select("id", "body_hash", embed()(embedding_text()).alias("vector")).where("vector is not null")


def start(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, embed: Callable = embedder, files_per_trigger: int = 32) -> StreamingQuery:
    """Embed the notes of a folder's new Parquet files and append them to the vector table; a batch that fails is tried again."""
    ship(spark)
    notes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        drained(rows.dropDuplicates(["id"]), embed).withColumn("batch", F.lit(number)).write.mode("append").parquet(index)

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
