"""Session helpers shared by the operators: reading tables, scratch tables, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory does not follow text length; and send the workers this package.

    The bounds are read when a plan runs, so they stay in the session; bounds that are tighter already are left alone.
    """
    ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lorewell-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Written tables that cut lineage: after ``save`` a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.tables: list[tuple[DataFrame, str]] = []
        self.within = 0

    def inner(self) -> Scratch:
        """A scratch folder inside this one, whose tables come and go by themselves."""
        self.within += 1
        out = Scratch.__new__(Scratch)
        out.spark, out.path, out.n, out.tables, out.within = self.spark, f"{self.path}/in{self.within}", 0, [], 0
        return out

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete single tables that no later read needs."""
        for t, path in self.tables:
            if any(t is x for x in tables):
                self._delete(path)
        self.tables = [(t, path) for t, path in self.tables if not any(t is x for x in tables)]

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables saved so far but these."""
        self.drop(*[t for t, _ in self.tables if not any(t is x for x in tables)])

    def clear(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Name of the column that tells rows apart whatever their ids are.
ROW = "_lorewell_row"


def keyed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` and ROW, a key of each row: its file and its place in the file, which every scan gives alike.

    What is no plain scan of Parquet files is written first. Ids may be null or repeated; decisions about rows go by this key.
    """
    try:
        return _placed(docs)
    except AnalysisException:
        return _placed(scratch.save(docs))


def _placed(docs: DataFrame) -> DataFrame:
    at = docs.metadataColumn("_metadata")
    out = docs.withColumn(ROW, F.struct(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].cast("long").alias("i")))
    out.schema  # noqa: B018  (analysis)
    return out


#: A key is hot when it holds more than one in HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 512


def lookup(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """Left-join ``keyed`` (one row per key, ``size`` = its number of rows) to ``rows`` whatever the skew.

    Keys with over 1/HOT_SHARE of the rows are at most HOT_SHARE rows and are broadcast; their rows get
    a random second key, so the sort-merge join that serves all other keys sees no large group.
    A null key finds nothing.
    """
    cols = [c for c in keyed.columns if c != key]
    total = keyed.agg(F.sum(size).alias("_total"))
    hot = keyed.join(F.broadcast(total), F.col(size) * F.lit(HOT_SHARE) > F.col("_total")).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot"))
    cold = keyed.select(F.col(key).alias("_ck"), F.lit(0).alias("_cs"), F.struct(*cols).alias("_cold"))
    spread = rows.join(F.broadcast(hot), rows[key] == F.col("_hk"), "left")
    spread = spread.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(F.monotonically_increasing_id() % 4096 + 1))
    out = spread.join(cold, (spread[key] == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*[out[c] for c in rows.columns], *[found[c].alias(c) for c in cols])


def null_to_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def range_sorted(scratch: Scratch, df: DataFrame, order: list[str], value: str | None = None) -> DataFrame:
    """Global order without a single-task sort: ``_pos`` (from 0) and, of ``value``, the running sum ``_sum``.

    Rows are dealt by range and written with the number of their range, which fixes the ranges;
    then only one row per range (counts, sums) is summed over the whole, and rows are numbered
    within their range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    amount = F.col(value) if value else F.lit(0)
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(amount).alias("_v"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = ranges.select("_range", F.coalesce(F.sum("_n").over(before), zero).alias("_n0"), F.coalesce(F.sum("_v").over(before), zero).alias("_v0"))
    inside = W.partitionBy("_range").orderBy(*order)
    rows = dealt.withColumn("_k", F.row_number().over(inside)).withColumn("_s", F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, (F.col("_n0") + F.col("_k") - 1).alias("_pos"), *([(F.col("_v0") + F.col("_s")).alias("_sum")] if value else []))
