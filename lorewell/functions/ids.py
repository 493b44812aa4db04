"""Content-addressed ids, hashes and UTC time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The note types in their order, and the edge kinds in theirs.
TYPES = ["fact", "decision", "question", "task", "def", "error", "snippet", "link", "meta", "risk"]
EDGE_KINDS = ["references", "depends_on", "contradicts", "supports", "extends", "replaces", "rejects", "results_in", "same_as", "broader", "narrower", "related"]
ID_PATTERN = rf"^(?:{'|'.join(TYPES)}|epic|container)_[0-9a-z]{{8}}$"


def normalised(text: Column) -> Column:
    """Trimmed, each run of white space one space. Text is taken as composed (NFC); compose it before where it may not be."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def base36(text: Column) -> Column:
    """Eight base-36 digits of the first 32 bits of the SHA-256."""
    return F.lower(F.lpad(F.conv(F.left(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(8)), 16, 36), 8, "0"))


def note_id(kind: Column, statement: Column) -> Column:
    return F.concat(kind, F.lit("_"), base36(F.concat(kind, F.lit("\u001f"), normalised(statement))))


def body_hash(statement: Column, body: Column) -> Column:
    return F.left(F.sha2(F.encode(F.concat(normalised(statement), F.lit("\n"), normalised(body)), "UTF-8"), 256), F.lit(8))


def event_id(content: Column) -> Column:
    """``content``: canonical JSON of the event."""
    return F.concat(F.lit("evt_"), base36(content))


def valid_id(c: Column) -> Column:
    return F.rlike(c, F.lit(ID_PATTERN))


def parse_utc(text: Column) -> Column:
    """Milliseconds of YYYY-MM-DDTHH:MM:SS[.fraction]Z; fractions are cut to milliseconds, other offsets give null."""
    ok = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"))
    cut = F.regexp_replace(text, r"(\.\d{3})\d+Z$", "$1Z")
    return F.when(ok, F.unix_millis(F.try_to_timestamp(cut)))


def format_utc(ms: Column) -> Column:
    """Whatever the session's time zone: the seconds are added to a timestamp without one."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(ms / 1000).cast("decimal(18,6)"))
    return F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("."), F.lpad((F.pmod(ms, F.lit(1000))).cast("string"), 3, "0"), F.lit("Z"))


def agent_of(agent_id: Column, agent: Column) -> Column:
    return F.coalesce(agent_id, agent, F.lit("legacy"))
