"""Updates with all that follows from them: guards, new revisions, supersessions with their links and back-pointers, events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.ids import EDGE_KINDS, body_hash, note_id
from lorewell.functions.runtime import written


@dataclass(frozen=True)
class Outcome:
    """outcomes (line, id, new_id, action, revision, problem); notes, edges and events (op, note_id, at, new_id) after them."""

    outcomes: DataFrame
    notes: DataFrame
    edges: DataFrame
    events: DataFrame


def updated(notes: DataFrame, edges: DataFrame, patches: DataFrame, now_ms: int) -> Outcome:
    """Notes (id, type, statement, body, status, superseded_by, revision, created_ms, ...) after patches (line, id, type, statement, body, expected_hash; null keeps).

    A patch of an unknown note, of a note whose hash is not the expected one, of one that an earlier line patches, or to an id that is taken is
    refused. Another type or statement makes a new note that replaces the old one, which becomes superseded; all else is a new revision.
    A note whose id was never derived from its content keeps it as long as type and statement stay.
    """
    p = patches.select("line", "id", F.col("type").alias("_t"), F.col("statement").alias("_s"), F.col("body").alias("_b"), "expected_hash")
    own = notes.select("id", "type", "statement", "body", "revision", F.lit(True).alias("_known"))
    rows = p.join(own, "id", "left").withColumn("_type", F.coalesce("_t", "type")).withColumn("_statement", F.coalesce("_s", "statement")).withColumn("_body", F.coalesce("_b", "body"))
    rows = rows.withColumn("_new", note_id(F.col("_type"), F.col("_statement")))
    same = F.col("_type").eqNullSafe(F.col("type")) & F.col("_statement").eqNullSafe(F.col("statement"))
    stays = (F.col("_new") == F.col("id")) | (same & (note_id(F.col("type"), F.col("statement")) != F.col("id"))) | F.col("_new").isNull()
    again = F.row_number().over(W.partitionBy("id").orderBy("line")) > 1
    twin = F.row_number().over(W.partitionBy("_new").orderBy("line")) > 1
    taken = notes.select(F.col("id").alias("_new"), F.lit(True).alias("_taken"))
    rows = rows.withColumn("_stays", stays).withColumn("_again", again).withColumn("_twin", twin).join(taken, "_new", "left")
    stale = F.col("expected_hash").isNotNull() & (F.col("expected_hash") != body_hash(F.col("statement"), F.col("body")))
    problem = (
        F.when(F.col("_known").isNull(), "unknown id").when(stale, "another hash").when(F.col("_again"), "patched twice").when(~F.col("_stays") & (F.coalesce("_taken", F.lit(False)) | F.col("_twin")), "id is taken")
    )
    rows = written(rows.withColumn("problem", problem))
    action = F.when(F.col("problem").isNull(), F.when(F.col("_stays"), "revised").otherwise("superseded"))
    revision = F.when(F.col("problem").isNull(), F.coalesce("revision", F.lit(0)) + 1)
    outcomes = rows.select("line", "id", F.when(action == "superseded", F.col("_new")).alias("new_id"), action.alias("action"), revision.alias("revision"), "problem")

    good = rows.where("problem is null").select("id", "_stays", "_new", "_type", "_statement", "_body", F.lit(True).alias("_hit"))
    after = notes.join(good, "id", "left")
    revised, old = F.col("_hit") & F.col("_stays"), F.col("_hit") & ~F.col("_stays")
    change = {
        "type": F.when(revised, F.col("_type")).otherwise(F.col("type")), "statement": F.when(revised, F.col("_statement")).otherwise(F.col("statement")), "body": F.when(revised, F.col("_body")).otherwise(F.col("body")),
        "status": F.when(old, "superseded").otherwise(F.col("status")), "superseded_by": F.when(old, F.col("_new")).otherwise(F.col("superseded_by")),
        "revision": F.when(F.col("_hit"), F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")),
    }
    fresh = {
        "id": F.col("_new"), "type": F.col("_type"), "statement": F.col("_statement"), "body": F.col("_body"), "status": F.lit("active"), "superseded_by": F.lit(None).cast("string"), "revision": F.lit(None).cast(notes.schema["revision"].dataType),
        "created_ms": F.lit(now_ms).cast("long"),
    }
    pick = lambda how: [how.get(c, F.col(c)).cast(notes.schema[c].dataType).alias(c) for c in notes.columns]
    made = after.where(old)
    links = made.select(F.col("_new").alias("src"), F.lit("replaces").alias("kind"), F.col("id").alias("dst"))
    carried = edges.where("kind <> 'replaces'").join(made.select(F.col("id").alias("src"), "_new"), "src").where(F.col("dst") != F.col("_new")).select(F.col("_new").alias("src"), "kind", "dst")
    events = rows.where("problem is null").select(F.when(F.col("_stays"), "update").otherwise("supersede").alias("op"), F.col("id").alias("note_id"), F.lit(now_ms).cast("long").alias("at"), F.when(~F.col("_stays"), F.col("_new")).alias("new_id"))
    return Outcome(outcomes, after.select(*pick(change)).unionByName(made.select(*pick(fresh))), edges.select("src", "kind", "dst").union(carried).union(links), events)


def linked(notes: DataFrame, edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, edges, outcomes) after links (line, src, kind, dst); outcomes (line, problem, new).

    A link to itself, of an unknown kind, or from no note is refused; one that is there is not doubled; one to no note dangles. A new link is a revision of
    its note. Of a new replaces, the note that is replaced is superseded, a revision too, and points back to the one that replaces it: that of the last line.
    """
    ids = notes.select(F.col("id").alias("src"), F.lit(True).alias("_there"))
    old = edges.select("src", "kind", "dst", F.lit(True).alias("_old")).distinct()
    rows = links.join(ids, "src", "left").join(old, ["src", "kind", "dst"], "left")
    problem = F.when(F.col("src") == F.col("dst"), "to itself").when(~F.col("kind").isin(*EDGE_KINDS), "unknown kind").when(F.col("_there").isNull(), "no such note")
    first = F.row_number().over(W.partitionBy("src", "kind", "dst").orderBy("line")) == 1
    rows = written(rows.withColumn("problem", problem).withColumn("new", F.col("problem").isNull() & F.col("_old").isNull() & first))
    made = rows.where("new").select("src", "kind", "dst", "line")
    back = made.where("kind = 'replaces'").groupBy(F.col("dst").alias("id")).agg(F.max_by("src", "line").alias("_by"), F.count("*").alias("_in"))
    out = made.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_out"))
    more = F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))
    revision = F.when(more > 0, F.coalesce("revision", F.lit(0)) + more).otherwise(F.col("revision")).cast(notes.schema["revision"].dataType)
    after = notes.join(back, "id", "left").join(out, "id", "left").withColumn("revision", revision).withColumn("superseded_by", F.coalesce("_by", "superseded_by"))
    after = after.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).select(*notes.columns)
    return after, edges.select("src", "kind", "dst").union(made.select("src", "kind", "dst")), rows.select("line", "problem", "new")
