"""Writes as set operations: each takes notes and a batch, and gives the notes after it, or what each row of the batch did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.corpus import Corpus, Settings
from lorewell.functions.ids import EDGE_KINDS, TYPES, body_hash, note_id
from lorewell.operators.dedup import similar_sets, term_sets, write_decisions
from lorewell.operators.filters import glob_pairs, hierarchy_allowed, task_transition_allowed, transition_allowed

MAX_DOCS, MAX_PROPOSALS = 64, 50


def identified(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn("id", note_id(F.col("type"), F.col("statement"))).withColumn("body_hash", body_hash(F.col("statement"), F.col("body")))


def plan_writes(notes: DataFrame, drafts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(draft_id, id, action, target): refused, unchanged, conflict, rejected, merged or created. Rows of a batch don't see each other."""
    rows = identified(drafts)
    known = notes.select("id", F.col("body_hash").alias("_h"), F.lit(True).alias("_known"))
    rows = rows.join(known, "id", "left").join(write_decisions(notes, drafts, s), "draft_id", "left")
    action = (
        F.when(F.col("type").isin("task", "epic"), "refused").when(F.col("_known") & (F.col("_h") == F.col("body_hash")), "unchanged").when(F.col("_known"), "conflict")
        .when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "merge", "merged").otherwise("created")
    )
    return rows.select("draft_id", "id", action.alias("action"), F.when(action.isin("rejected", "merged"), F.col("best_id")).alias("target"))


def merged(notes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Notes after merging (target, tags, anchors, body): lists are joined in the order of their values, so runs agree, a body that is not contained is appended."""
    one = incoming.groupBy(F.col("target").alias("id")).agg(F.flatten(F.sort_array(F.collect_list("tags"))).alias("_t"), F.flatten(F.sort_array(F.collect_list("anchors"))).alias("_a"), F.sort_array(F.collect_list("body")).alias("_b"))
    rows = notes.join(one, "id", "left")
    none = F.array().cast("array<string>")
    more = F.filter(F.coalesce("_b", none), lambda b: ~F.contains(F.col("body"), b))
    body = F.when(F.size(more) > 0, F.concat_ws("\n\n", F.array("body"), more)).otherwise(F.col("body"))
    return rows.withColumn("tags", F.array_union("tags", F.coalesce("_t", none))).withColumn("anchors", F.array_union("anchors", F.coalesce("_a", none))).withColumn("body", body).select(*notes.columns)


def linked(edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after, refused): links (src, kind, dst) without doubles; a link to itself or of an unknown kind is refused."""
    bad = (F.col("src") == F.col("dst")) | ~F.col("kind").isin(*EDGE_KINDS)
    good = links.where(~bad).select("src", "kind", "dst")
    return edges.select("src", "kind", "dst").union(good).distinct(), links.where(bad)


def changed_status(notes: DataFrame, changes: DataFrame, tasks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(notes after, refused) of changes (id, target), one per note."""
    allowed = task_transition_allowed if tasks else transition_allowed
    rows = notes.join(changes.select("id", "target"), "id", "left")
    ok = F.coalesce(allowed(F.col("status"), F.col("target")), F.lit(False))
    after = rows.withColumn("status", F.when(F.col("target").isNotNull() & ok, F.col("target")).otherwise(F.col("status")))
    return after.select(*notes.columns), rows.where(F.col("target").isNotNull() & ~ok).select("id", "status", "target")


def updated(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, new_id, action, status, revision) of patches (id, type, statement, body; null keeps): a new type or statement supersedes, else the revision grows."""
    p = patches.select("id", F.col("type").alias("_t"), F.col("statement").alias("_s"), F.col("body").alias("_b"))
    rows = notes.join(p, "id")
    kind, statement = F.coalesce("_t", F.col("type")), F.coalesce("_s", F.col("statement"))
    moved = (kind != F.col("type")) | (statement != F.col("statement"))
    new = F.when(moved, note_id(kind, statement)).otherwise(F.col("id"))
    return rows.select("id", new.alias("new_id"), F.when(moved, "supersede").otherwise("update").alias("action"), F.when(moved, "superseded").otherwise(F.col("status")).alias("status"), (F.coalesce("revision", F.lit(1)) + F.when(moved, 0).otherwise(1)).alias("revision"))


def plan_tasks(notes: DataFrame, items: DataFrame) -> DataFrame:
    """(key, problem) of new items (key, scope, parent): parents may be other keys or notes; null is no problem."""
    known = notes.select(F.col("id").alias("parent"), F.col("scope").alias("_ps"))
    own = items.select(F.col("key").alias("parent"), F.col("scope").alias("_ps"))
    rows = items.join(known.union(own), "parent", "left")
    problem = F.when((F.col("scope") == "epic") & F.col("parent").isNotNull(), "an epic has no parent").when(F.col("parent").isNotNull() & F.col("_ps").isNull(), "unknown parent").when(F.col("parent").isNotNull() & ~hierarchy_allowed(F.col("_ps"), F.col("scope")), "a parent must be of a higher scope")
    return rows.select("key", problem.alias("problem"))


def demoted(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """Notes after forgetting what a demotion plan (id, action) says."""
    gone = plan.where("action = 'forget'").select("id", F.lit("forgotten").alias("target"))
    return changed_status(notes, gone)[0]


def learn(corpus: Corpus, changed: list[str], scope: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """(kind, a, b, score): gaps, duplicates and missing links among the first MAX_DOCS notes of a scope; at most MAX_PROPOSALS.

    Both limits are the report's own.
    """
    spark = corpus.notes.sparkSession
    notes = corpus.notes.join(scope.select("id"), "id", "left_semi") if scope is not None else corpus.notes
    docs = notes.orderBy("id").limit(MAX_DOCS)
    anchors = docs.select("id", "scope", "successes", F.explode("anchors").alias("anchor"))
    paths = spark.createDataFrame([(p,) for p in changed], "path string")
    seen = glob_pairs(anchors.select(F.col("anchor").alias("pattern")).distinct(), paths).select("path")
    none = F.lit(None).cast("string")
    gaps = paths.join(seen, "path", "left_anti").select(F.lit("create_note").alias("kind"), F.col("path").alias("a"), none.alias("b"), F.lit(0.5).alias("score"))
    known = anchors.where("scope is null").select("anchor").distinct()
    both = glob_pairs(anchors.select(F.col("anchor").alias("pattern")).distinct(), known.select(F.col("anchor").alias("path"))).select(F.col("pattern").alias("anchor"))
    back = glob_pairs(known.select(F.col("anchor").alias("pattern")), anchors.select(F.col("anchor").alias("path")).distinct()).select(F.col("path").alias("anchor"))
    tasks = anchors.where("scope is not null and successes > 0").select("anchor").distinct()
    lost = tasks.join(both.union(back).distinct(), "anchor", "left_anti").select(F.lit("create_note"), "anchor", none, F.lit(0.6))
    out = gaps.union(lost)
    for part, fields in ((docs.where("scope is null"), ("statement", "body", "tags")), (docs, ("statement",))):
        members, pairs = similar_sets(term_sets(part, fields), s.create_below)
        same = members.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
        rows = same.union(pairs)
        if fields == ("statement",):
            task = docs.select("id", F.col("scope").isNotNull().alias("_t"))
            rows = rows.join(task.toDF("a", "_x"), "a").join(task.toDF("b", "_y"), "b").where("_x or _y").select("a", "b", "score")
        out = out.union(rows.select(F.when(F.col("score") >= s.merge_below, "supersede").otherwise("merge"), "a", "b", "score"))
    x, y = anchors.select(F.col("id").alias("a"), "anchor"), anchors.select(F.col("id").alias("b"), "anchor")
    near = corpus.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links = x.join(y, "anchor").where("a < b").select("a", "b").distinct().join(near, ["a", "b"], "left_anti").select(F.lit("link"), "a", "b", F.lit(0.4))
    return out.union(links).dropDuplicates(["kind", "a", "b"]).orderBy("kind", F.desc("score"), "a", "b").limit(MAX_PROPOSALS)



def hub_notes(found: DataFrame) -> DataFrame:
    """(id, statement, edges) of notes that name each cluster (axis, key, id) and refer to its members."""
    name = F.concat_ws(" ", F.lit("Hub"), "axis", "key")
    return found.groupBy("axis", "key").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(note_id(F.lit("meta"), name).alias("id"), name.alias("statement"), F.transform("ids", lambda i: F.struct(F.lit("references").alias("kind"), i.alias("to"))).alias("edges"))


def hints(candidates: DataFrame, shown: DataFrame, cap: int = 3) -> DataFrame:
    """The first ``cap`` hints (id, priority) not shown in the session before."""
    return candidates.dropDuplicates(["id"]).join(shown.select("id"), "id", "left_anti").orderBy("priority", "id").limit(cap)


def outcomes_appended(notes: DataFrame, results: DataFrame) -> DataFrame:
    """Notes (with outcomes and revision) after results (id, status, recorded_ms, notes): appended by time, each adds one to the revision."""
    entry = F.struct("recorded_ms", "status", F.col("notes").alias("notes"))
    more = results.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("_more"))
    rows = notes.join(more, "id", "left")
    kind = notes.schema["outcomes"].dataType.elementType
    field = {"recorded_ms": lambda x: x["recorded_ms"], "status": lambda x: x["status"], "notes": lambda x: x["notes"]}
    new = F.transform("_more", lambda x: F.struct(*[(field[f.name](x) if f.name in field else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]))
    none = F.array().cast(notes.schema["outcomes"].dataType)
    grown = F.concat(F.coalesce("outcomes", none), F.coalesce(new, none))
    return rows.withColumn("outcomes", grown).withColumn("revision", F.coalesce("revision", F.lit(1)) + F.coalesce(F.size("_more"), F.lit(0))).select(*notes.columns)


# What a draft may hold.
DRAFT_KEYS = ["type", "statement", "body", "tags", "anchors", "source", "classification", "status", "claims", "provenance"]
CLASSES = ["foundational", "tactical", "observational"]
STATUSES = ["active", "in_progress", "blocked", "closed", "superseded", "forgotten"]


def draft_problems(drafts: DataFrame) -> DataFrame:
    """(draft_id, problem) of drafts (draft_id, json): no object, an unknown key, no statement, or a value outside its set; null is no problem."""
    keys = F.json_object_keys("json")
    odd = F.array_min(F.array_except(keys, F.array(*map(F.lit, DRAFT_KEYS))))
    value = lambda k: F.get_json_object("json", f"$.{k}")
    outside = lambda k, those: value(k).isNotNull() & ~value(k).isin(*those)
    problem = (
        F.when(keys.isNull(), "not an object").when(odd.isNotNull(), F.concat(F.lit("unknown key: "), odd)).when(F.coalesce(value("statement"), F.lit("")) == "", "no statement")
        .when(outside("type", [*TYPES, "epic"]), "unknown type").when(outside("classification", CLASSES), "unknown classification").when(outside("status", STATUSES), "unknown status")
    )
    return drafts.select("draft_id", problem.alias("problem"))
