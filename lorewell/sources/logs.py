"""NDJSON shards and rotated event logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import NOTES
from lorewell.functions.ids import event_id
from lorewell.functions.runtime import running, written
from lorewell.sources.versions import Versions

EVENT = "id STRING, op STRING, note_id STRING, at BIGINT, data MAP<STRING, STRING>"


def first_per_id(rows: DataFrame) -> DataFrame:
    """The first row of each id in reading order (_segment, _line)."""
    first = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("_segment", "_line")).alias("x"))
    return first.select("id", "x.*")


def latest_per_id(rows: DataFrame) -> DataFrame:
    """Across shards the row with the largest (created_ms, agent_id, file) wins."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("created_ms", "agent_id", "_origin")).alias("x"))
    return last.select("id", "x.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _origin, _line): lines in file order."""
    text = spark.read.text(path, wholetext=True).withColumn("_origin", F.input_file_name())
    return text.select("_origin", F.posexplode(F.split("value", "\n")).alias("_line", "value")).where("trim(value) <> ''")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of a folder with events-NNNN.jsonl segments and the active events.jsonl; of equal ids the first stays."""
    lines = _lines(spark, path)
    name = F.regexp_extract("_origin", r"([^/]+)$", 1)
    segment = F.when(name == "events.jsonl", "~").otherwise(name)
    parsed = lines.select(F.from_json("value", EVENT + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"), segment.alias("_segment"), "_line", "value")
    good = parsed.where("e is not null and e._corrupt is null and e.op is not null and e.at is not null").select("e.id", "e.op", "e.note_id", "e.at", "e.data", "_segment", "_line")
    bad = parsed.where("e is null or e._corrupt is not null or e.op is null or e.at is null").select("_segment", "_line", "value")
    return first_per_id(good), bad


def malformed(lines: DataFrame) -> DataFrame:
    """(value): lines (value) that are no events: no JSON, or without id, op or time."""
    e = F.from_json("value", EVENT + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(F.trim("value") != "").select("value", e.alias("e")).where("e is null or e._corrupt is not null or e.id is null or e.op is null or e.at is null").select("value")


def canonical(op: Column, note: Column, at: Column, data: Column) -> Column:
    """JSON of an event's content with sorted keys; absent fields are left out."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(data)))
    return F.to_json(F.struct(at.alias("at"), entries.alias("data"), note.alias("note_id"), op.alias("op")))


def with_event_ids(events: DataFrame) -> DataFrame:
    return events.withColumn("id", event_id(canonical(F.col("op"), F.col("note_id"), F.col("at"), F.col("data"))))


def append_events(events: DataFrame, path: str, records: int = 10_000) -> None:
    events.select("id", "op", "note_id", "at", "data").write.mode("append").option("maxRecordsPerFile", records).json(path)


#: Bytes of lines in a segment of the log.
SEGMENT_BYTES = 1 << 20


def segmented(events: DataFrame, limit: int = SEGMENT_BYTES, bytes_before: int = 0) -> DataFrame:
    """``events``, ``bytes`` of each one's line and ``segment``: a line is in the segment in which it begins. ``bytes_before`` are in the log already."""
    line = F.octet_length(F.to_json(F.struct("at", F.map_from_entries(F.array_sort(F.map_entries("data"))).alias("data"), "id", "note_id", "op"))) + 1
    rows = running(events.withColumn("bytes", line.cast("long")), "bytes", "at", "id")
    return rows.withColumn("segment", F.floor((F.col("before") + bytes_before) / limit).cast("int")).select(*events.columns, "bytes", "segment")


def append_rotated(versions: Versions, events: DataFrame, limit: int = SEGMENT_BYTES) -> int:
    """Append events to a log whose segments are cut by bytes; the log's length is in the manifest, so a killed append leaves no gap."""
    number, manifest = versions.current()
    rows = written(segmented(events.select("id", "op", "note_id", "at", "data"), limit, manifest.get("bytes", 0)))
    added = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = [*manifest["tables"].get("events", []), versions.part(rows.repartitionByRange("segment", "at", "id"), "events", "segment")]
    return versions.commit(number, manifest | {"tables": manifest["tables"] | {"events": parts}, "bytes": manifest.get("bytes", 0) + added})


def rotated(versions: Versions) -> DataFrame:
    """The events of a log written by ``append_rotated``, with bytes and segment."""
    return versions.read(versions.current()[1], "events", EVENT + ", bytes BIGINT, segment INT")


def since(events: DataFrame, checkpoint: str) -> DataFrame:
    """Events after a checkpoint's in reading order; all of them where the checkpoint is unknown."""
    mark = events.where(F.col("id") == checkpoint).agg(F.max(F.struct("_segment", "_line")).alias("_mark"))
    return events.join(F.broadcast(mark), F.lit(True)).where("_mark is null or struct(_segment, _line) > _mark").drop("_mark")


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, warnings) of NDJSON lines {"frontmatter": {...}, "body": ...}: last line per id of a file, then the winner across files."""
    front = re.sub(r"\s+", " ", NOTES).strip().replace("body STRING, ", "").replace(", _corrupt STRING, _origin STRING", "")
    front = front.replace("created_ms BIGINT", "created_at STRING").replace("edges ARRAY<STRUCT<kind: STRING, to: STRING>>,", "")
    schema = f"frontmatter STRUCT<{_fields(front)}>, body STRING, _corrupt STRING"
    lines = _lines(spark, path)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("n"), "_origin", "_line", "value")
    bad = parsed.where("n is null or n._corrupt is not null or n.frontmatter.id is null").select("_origin", "_line", "value")
    from lorewell.functions.ids import agent_of, parse_utc

    good = parsed.where("n is not null and n._corrupt is null and n.frontmatter.id is not null").select("n.frontmatter.*", "n.body", "_origin", "_line")
    good = good.withColumn("created_ms", F.coalesce(parse_utc(F.col("created_at")), F.lit(0))).withColumn("agent_id", agent_of(F.col("provenance.agent_id"), F.col("provenance.agent")))
    last = W.partitionBy("_origin", "id").orderBy(F.desc("_line"))
    one = good.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_line", "created_at")
    return latest_per_id(one), bad


def _fields(columns: str) -> str:
    """Column definitions as the fields of a struct."""
    out, depth = [], 0
    for part in re.split(r"([<>,])", columns):
        depth += part.count("<") - part.count(">")
        if depth == 0 and part not in "<>," and " " in part.strip():
            name, kind = part.strip().split(" ", 1)
            part = f"{name}: {kind}"
        elif depth > 0 and " " in part.strip() and ":" not in part:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}: {kind}"
        out.append(part)
    return "".join(out)


def shard_file_name(agent: Column) -> Column:
    """Safe file name of an agent's shard; a changed or long name gets a hash."""
    clean = F.left(F.regexp_replace(agent, "[^A-Za-z0-9._-]", "_"), F.lit(48))
    plain = (clean == agent) & ~F.startswith(agent, F.lit(".")) & (F.length(agent) > 0)
    return F.concat(F.when(plain, agent).otherwise(F.concat(clean, F.lit("-"), F.left(F.sha2(F.encode(agent, "UTF-8"), 256), F.lit(8)))), F.lit(".jsonl"))
