"""Task views: lists, context, roles, modes, program roots, and notes by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.globs import either_matches
from lorewell.functions.runtime import written
from lorewell.operators.filters import Filter, actionable, work_item
from lorewell.operators.graph import epic_of, impact, in_scope, of_kind, parents, progress, views


def guarded(f: Filter, universe: bool = False, around: str | None = None) -> Filter:
    """``f``, or an error where a report over the whole corpus was not asked for by ``universe``."""
    if f == Filter() and not universe and around is None:
        raise ValueError("a filter, a note to look around, or universe is required")
    return f


def by_ids(notes: DataFrame, ids: list[str]) -> DataFrame:
    """(position, id, statement, found) of the ids in their order; ids without a note are reported, not dropped."""
    wanted = notes.sparkSession.createDataFrame(list(enumerate(ids)), "position long, id string")
    rows = wanted.join(notes.select("id", "statement", F.lit(True).alias("_f")), "id", "left")
    return rows.select("position", "id", "statement", F.coalesce("_f", F.lit(False)).alias("found"))


def task_list(corpus: Corpus, f: Filter = Filter(), level: str | None = None, container: str | None = None, parent: str | None = None, view: str | None = None, universe: bool = False) -> DataFrame:
    """(id, scope, status, reason, impact) of the work items that pass all filters; ``view`` is ready or blocked, and one filter at least is required."""
    if not (level or container or parent or view):
        guarded(f, universe)
    rows = corpus.notes.where(work_item() & f.column())
    if level:
        rows = rows.where(F.col("scope") == level)
    if container:
        rows = rows.join(in_scope(corpus, container), "id", "left_semi")
    if parent:
        rows = rows.join(parents(corpus.edges).where(F.col("parent") == parent), "id", "left_semi")
    state = views(corpus)
    rows = rows.join(state.where(F.col("state") == view) if view else state, "id", "inner" if view else "left").join(impact(corpus), "id", "left")
    return rows.select("id", "scope", "status", "reason", F.coalesce("impact", F.lit(0)).cast("long").alias("impact"))


def program_roots(corpus: Corpus, path: str) -> DataFrame:
    """(id): epics without a parent whose anchors match a path, or are matched by it."""
    hit = F.exists("anchors", lambda a: either_matches(a, F.lit(path)))
    rows = corpus.notes.where((F.col("scope") == "epic") & F.coalesce(hit, F.lit(False)))
    return rows.select("id").join(parents(corpus.edges), "id", "left_anti")


def depths(corpus: Corpus) -> DataFrame:
    """(id, depth) below parentless notes along each note's parent; notes on a cycle of parents have none."""
    up = written(parents(corpus.edges))
    level = corpus.notes.select("id").join(up, "id", "left_anti").withColumn("depth", F.lit(0))
    out = level = written(level)
    while True:
        below = up.join(level.withColumnRenamed("id", "parent"), "parent").select("id", (F.col("depth") + 1).alias("depth"))
        level = written(below.join(corpus.notes.select("id"), "id", "left_semi"))
        if level.isEmpty():
            return out
        out = out.union(level)


def roles(corpus: Corpus) -> DataFrame:
    """(id, depth, role): the note's type decides where it tells a role, else its depth and whether it has children."""
    kids = corpus.edges.where("kind = 'results_in'").select(F.col("src").alias("id")).distinct().withColumn("_kids", F.lit(True))
    rows = corpus.notes.select("id", "type").join(depths(corpus), "id").join(kids, "id", "left")
    role = (
        F.when(F.col("type") == "error", "Bug").when(F.col("type") == "question", "Spike").when(F.col("type") == "risk", "Risk").when(F.col("type") == "decision", "Decision")
        .when(F.col("depth") == 0, "Epic").when((F.col("depth") == 1) & F.col("_kids"), "Feature").when(F.col("depth") == 1, "Story").otherwise("Sub-task")
    )
    return rows.select("id", F.col("depth").cast("long").alias("depth"), role.alias("role"))


def modes(corpus: Corpus) -> DataFrame:
    """(id, mode) of notes with children: magentic where they were submitted at two instants or more, sequential where
    each but the first by id depends on an earlier sibling, else concurrent."""
    kids = of_kind(corpus.edges, "results_in").toDF("id", "child")
    submitted = corpus.events.where("op = 'task' and action = 'submit' and note_id is not null").groupBy(F.col("note_id").alias("child")).agg(F.max_by("at", "event_id").alias("at"))
    many = kids.join(submitted, "child", "left").groupBy("id").agg(F.count("*").alias("_n"), F.countDistinct("at").alias("_instants"))
    earlier = of_kind(corpus.edges, "depends_on").toDF("child", "before").where("before < child")
    told = earlier.join(kids, "child").join(kids.withColumnRenamed("child", "before"), ["id", "before"]).groupBy("id").agg(F.countDistinct("child").alias("_told"))
    ordered = (F.col("_n") < 2) | (F.coalesce("_told", F.lit(0)) == F.col("_n") - 1)
    return many.join(told, "id", "left").select("id", F.when(F.col("_instants") >= 2, "magentic").when(ordered, "sequential").otherwise("concurrent").alias("mode"))


def contexts(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """(id, relation, other, statement, scope, status, total, done): what stands around each of ``ids`` (id).

    relation is parent, blocked_by, blocks, child or epic; a note that does not exist has an empty statement and counts as active.
    """
    want = ids.select("id").distinct()
    up = parents(corpus.edges)
    depends, tree = of_kind(corpus.edges, "depends_on"), of_kind(corpus.edges, "results_in")
    rows = up.select("id", F.lit("parent").alias("relation"), F.col("parent").alias("other"))
    rows = rows.union(depends.select("src", F.lit("blocked_by"), "dst")).union(depends.where("src <> dst").select("dst", F.lit("blocks"), "src")).union(tree.select("src", F.lit("child"), "dst"))
    rows = rows.union(epic_of(corpus).select("id", F.lit("epic"), "epic")).join(want, "id", "left_semi")
    known = corpus.notes.select(F.col("id").alias("other"), "statement", "scope", "status")
    done = progress(corpus, rows.where("relation = 'epic'").select(F.col("other").alias("id")).distinct()).select(F.col("root").alias("other"), F.lit("epic").alias("relation"), "total", "done")
    rows = rows.join(known, "other", "left").join(done, ["other", "relation"], "left")
    return rows.select("id", "relation", "other", F.coalesce("statement", F.lit("")).alias("statement"), "scope", F.coalesce("status", F.lit("active")).alias("status"), "total", "done")


def agent_memory(notes: DataFrame, agent: str | None = None, sort: str = "time", limit: int = 50) -> DataFrame:
    """(id, agent_id, created_ms, statement) of agents' notes, of one or all, newest first or by id; ``limit`` is the report's length."""
    rows = notes.where("agent_id is not null") if agent is None else notes.where(F.col("agent_id") == agent)
    order = ["id"] if sort == "id" else [F.desc("created_ms"), "id"]
    return rows.select("id", "agent_id", "created_ms", "statement").orderBy(*order).limit(limit)


def still_to_do(corpus: Corpus) -> DataFrame:
    """(status, n): the work items that can be acted on, by status."""
    return corpus.notes.where(work_item() & actionable()).groupBy("status").agg(F.count("*").alias("n"))
