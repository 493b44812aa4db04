"""The event log as a stream: each id once, tumbling throughput, and what a batch over the whole log gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.sources.logs import EVENT


def stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Events of a folder's new files; lines that are no events are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("op is not null and at is not null")
    return rows.withColumn("ts", F.timestamp_millis("at"))


def unique(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The first event of each id that arrives; state is kept for ``late`` behind the latest event."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def throughput(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start_ms, closed) by tumbling windows of review events."""
    done = events.where("op = 'task' and data['action'] = 'review'")
    return done.groupBy(F.window("ts", width)).agg(F.count("*").alias("closed")).select(F.unix_millis("window.start").alias("start_ms"), "closed")


def run_throughput(spark: SparkSession, path: str, name: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Update an in-memory table of the throughput until all files are read."""
    query = throughput(unique(stream(spark, path)), width).writeStream.outputMode("complete").format("memory").queryName(name)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
