"""Note directories, derived tables with a format header, and removal of notes from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import NOTES
from lorewell.functions.ids import EDGE_KINDS, parse_utc
from lorewell.functions.runtime import ship
from lorewell.sources import toon

FENCE = r"(?s)\A---\n(.*?)(?:^|\n)---(?:\n|\z)(.*)\z"


def split_document(text):
    """(has_fence, header, body): CRLF becomes LF; an opening fence needs a closing one."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    fenced = F.startswith(t, F.lit("---\n"))
    closed = F.rlike(t, F.lit(FENCE))
    return F.struct((~fenced | closed).alias("ok"), F.when(fenced, F.regexp_extract(t, FENCE, 1)).otherwise("").alias("header"), F.when(fenced, F.regexp_extract(t, FENCE, 2)).otherwise(t).alias("body"))


def read_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, warnings) of the Markdown files below a folder; the last path wins for an id."""
    ship(spark)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("_origin", F.input_file_name())
    split = files.withColumn("d", split_document(F.col("value")))
    parsed = split.withColumn("p", toon.to_json(F.col("d.header")))
    lists = ", ".join(f"{k} ARRAY<STRING>" for k in EDGE_KINDS)
    plain = "id STRING, type STRING, statement STRING, created_at STRING, body_hash STRING, schema_version INT, tags ARRAY<STRING>, source STRING, superseded_by STRING, revision INT, classification STRING, anchors ARRAY<STRING>, status STRING, scope STRING, checks ARRAY<STRING>, evidence MAP<STRING, STRING>"
    nested = "outcomes ARRAY<STRUCT<status: STRING, recorded_at: STRING, notes: STRING, duration: BIGINT, agent: STRING>>, claims ARRAY<STRUCT<subject: STRING, relation: STRING, object: STRING>>, provenance STRUCT<entity: STRING, activity: STRING, agent: STRING, agent_id: STRING, agent_role: STRING, parent_agent_id: STRING>"
    rows = parsed.withColumn("n", F.from_json("p.json", f"{plain}, {lists}, {nested}"))
    bad = rows.where("not d.ok or p.error is not null or n.id is null or n.statement is null").select("_origin", F.coalesce("p.error", F.when(~F.col("d.ok"), "unclosed fence"), F.lit("a required key is missing")).alias("warning"))
    good = rows.where("d.ok and p.error is null and n.id is not null and n.statement is not null").select("n.*", F.col("d.body").alias("body"), "_origin")
    to = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("to"))
    edges = F.flatten(F.array(*[F.transform(F.coalesce(k, F.array().cast("array<string>")), to(k)) for k in EDGE_KINDS]))
    last = W.partitionBy("id").orderBy(F.desc("_origin"))
    out = good.withColumn("edges", edges).withColumn("created_ms", parse_utc(F.col("created_at"))).withColumn("_k", F.row_number().over(last)).where("_k = 1")
    outcomes = F.transform("outcomes", lambda o: F.struct(o["status"].alias("status"), parse_utc(o["recorded_at"]).alias("recorded_ms"), o["notes"].alias("notes"), o["duration"].alias("duration"), o["agent"].alias("agent")))
    return out.withColumn("outcomes", outcomes).withColumn("_corrupt", F.lit(None).cast("string")).select(*[c for c in spark.createDataFrame([], NOTES).columns]), bad


def read_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, warnings) of whatever is at ``path``: one NDJSON file, a folder that holds NDJSON shards, or a folder of notes."""
    from lorewell.sources.logs import read_shards

    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        if not path.endswith((".jsonl", ".ndjson")):
            raise ValueError(f"no NDJSON file: {path}")
        return read_shards(spark, path)
    shards = any(s.isFile() and s.getPath().getName().endswith(".jsonl") for s in fs.listStatus(at))
    return read_shards(spark, path.rstrip("/") + "/*.jsonl") if shards else read_notes(spark, path)


def with_evidence(notes: DataFrame) -> DataFrame:
    """successes, failures, reviews and last_ms of each note's outcomes."""
    o = F.coalesce("outcomes", F.array().cast(notes.schema["outcomes"].dataType))
    count = lambda *s: F.size(F.filter(o, lambda x: x["status"].isin(*s)))
    return (
        notes.withColumn("successes", count("success") + count("partial") * 0.5).withColumn("failures", count("failure", "abandoned") + count("partial") * 0.5)
        .withColumn("reviews", count("success").cast("long")).withColumn("last_ms", F.array_max(F.transform(o, lambda x: x["recorded_ms"])))
    )


def edges_of(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.kind", F.col("e.to").alias("dst"))


def rendered(notes: DataFrame) -> DataFrame:
    """(id, value): each note's file; ``header`` is its JSON in key order."""
    return notes.select("id", F.concat(F.lit("---\n"), toon.from_json(F.col("header")), F.lit("---\n"), F.coalesce("body", F.lit(""))).alias("value"))


def save_table(df: DataFrame, path: str, format_name: str) -> None:
    """A derived table and its format name; a reader with another format sees none."""
    df.write.mode("overwrite").parquet(f"{path}/{format_name}")


def load_table(spark: SparkSession, path: str, format_name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{format_name}")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def rebuild(df: DataFrame, path: str) -> None:
    """Write beside a table, then take its place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(path), True)
    fs.rename(hadoop.Path(path + ".new"), hadoop.Path(path))
    spark.catalog.refreshByPath(path)


def without(table: DataFrame, removed: DataFrame) -> DataFrame:
    return table.join(removed.select("id"), "id", "left_anti")


def detached(notes: DataFrame, removed: DataFrame) -> DataFrame:
    """Notes without edges and back-pointers to removed ids; the removed ids are joined, not listed."""
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    hit = notes.select("id", F.explode("edges").alias("e")).join(gone, F.col("e.to") == F.col("_gone")).groupBy("id").agg(F.collect_set("_gone").alias("_cut"))
    rows = notes.join(gone, notes["id"] == F.col("_gone"), "left_anti").join(hit, "id", "left").join(gone.withColumnRenamed("_gone", "_sup"), F.col("superseded_by") == F.col("_sup"), "left")
    kept = F.when(F.col("_cut").isNull(), F.col("edges")).otherwise(F.filter("edges", lambda e: ~F.array_contains("_cut", e["to"])))
    return rows.withColumn("edges", kept).withColumn("superseded_by", F.when(F.col("_sup").isNull(), F.col("superseded_by"))).select(*notes.columns)


def cache_lookup(wanted: DataFrame, cache: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """(body_hash, cache_key, vector) of wanted keys; fresh entries only, the later then larger vector of conflicting ones."""
    fresh = cache.where(F.col("created_ms") + ttl_ms > now_ms)
    best = fresh.groupBy("body_hash", "cache_key").agg(F.max(F.struct("created_ms", "vector")).alias("x")).select("body_hash", "cache_key", "x.vector")
    return wanted.join(best, ["body_hash", "cache_key"], "left")


def project_paths(spark: SparkSession, root: str, ignored: tuple[str, ...] = (".git", "target", "node_modules")) -> DataFrame:
    """(path) of a project's files below ``root``, relative, without ignored folders and denied names."""
    from lorewell.functions.globs import denied

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    prefix = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + prefix.replace(".", r"\.") + "/", "")
    rows = files.select(rel.alias("path")).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))
    return rows.where(~denied(F.col("path")))
