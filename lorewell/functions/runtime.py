"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lorewell-"), "lorewell.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="lorewell-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than there are cores (one small file) is dealt to all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` and ``position`` (from 0) in a total order, without a single task that sorts or counts all rows.

    A global sort deals rows by range; each range's rows are numbered as they are written, and one number per range is summed up.
    """
    lanes = 33  # monotonically_increasing_id: the part's number above, the row's place in it below
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", lanes))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << lanes) - 1))
    return rows.join(F.broadcast(parts), "_part").withColumn("position", F.col("_start") + place).select(*df.columns, "position")


def running(df: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """``df``, ``position`` (from 0) and ``before``, the sum of ``value`` over all earlier rows, in a total order and without a single task that sums all."""
    lanes = 33
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", lanes))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"), F.coalesce(F.sum("_v").over(earlier), zero).alias("_v0"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), zero)
    place = F.col("_n0") + F.col("_at").bitwiseAND(F.lit((1 << lanes) - 1))
    return rows.withColumn("_own", own).join(F.broadcast(parts), "_part").select(*df.columns, place.alias("position"), (F.col("_v0") + F.col("_own")).alias("before"))
