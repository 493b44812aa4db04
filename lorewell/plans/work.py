"""Queries on recall's options, task views, hand-off, health and writes over the bound corpus."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lorewell.functions import text
from lorewell.functions.runtime import shared_dir
from lorewell.functions.ids import TYPES
from lorewell.operators import dedup, filters, flow, graph, handoff, lifecycle, retrieval, semantic, tasks, writes
from lorewell.operators.filters import Filter
from lorewell.plans.catalogue import AS_OF, PATHS, QUERY, _query_vector, _r, query
from lorewell.sources import bound
from lorewell.sources.logs import since

SCOPE = "n0000000010"


def _note(i: str):
    return F.expr(bound._note(i))


def _hashed(notes):
    return notes.withColumn("body_hash", F.left(F.md5(F.encode("body", "UTF-8")), F.lit(8)))


def _files(s, d):
    return bound.paths(s, d).withColumn("content_hash", F.left(F.md5(F.encode("path", "UTF-8")), F.lit(8)))


def _changed_files(s, d):
    first = F.substring("content_hash", 1, 1)
    return _files(s, d).where(~first.isin("0", "1")).withColumn("content_hash", F.when(first.isin("2", "3"), "changed").otherwise(F.col("content_hash")))


def _lines(s, d):
    n = _hashed(bound.notes(s, d)).where("doc_id % 25 = 0 or status in ('superseded', 'forgotten')")
    return n.select(F.col("doc_id").alias("position"), F.concat_ws("|", "id", text.one_line("statement"), "classification").alias("line"))


@query
def recall_scoped(s, d):
    c = bound.corpus(s, d)
    c = replace(c, edges=c.edges.withColumn("kind", F.when(F.col("kind") == "references", "depends_on").otherwise(F.col("kind"))))
    return retrieval.recall(c, QUERY, PATHS, None, limit=0, scope="n0000000002").select("id", "score", "confidence", "why", "lexical", "anchor")


@query
def recall_as_of(s, d):
    c = bound.corpus(s, d)
    return retrieval.recall(c, QUERY, PATHS, None, limit=25, as_of=AS_OF).select("id", "score", "confidence", "why")


@query
def why_labels(s, d):
    c = bound.corpus(s, d)
    out = retrieval.recall(c, QUERY, PATHS, _query_vector(c), Filter(statuses=("active", "closed")), limit=0, ids=("n0000000003", "n0000000064"))
    return out.groupBy("why").agg(F.count("*").alias("n"))


@query
def recall_authority(s, d):
    c = bound.corpus(s, d)
    c = replace(c, settings=replace(c.settings, ppr=1.0))
    return retrieval.recall(c, QUERY, PATHS, None, limit=25, ids=("n0000000004", "n0000000016", "n0000000027")).select("id", "score", "why")


@query
def ppr_ranks(s, d):
    c = bound.corpus(s, d)
    ranks = graph.pagerank(c.notes.select("id"), graph.of_kind(c.edges, *retrieval.AUTHORITY), c.notes.where("doc_id % 100 = 3").select("id"))
    return ranks.select("id", F.round(F.col("rank") * 1000, 6).alias("rank_per_mille"))


@query
def task_list(s, d):
    return tasks.task_list(bound.corpus(s, d), Filter(tags=("en", "de")), level="task", view="blocked")


@query
def task_list_in_container(s, d):
    return tasks.task_list(bound.corpus(s, d), container="n0000000001", parent="n0000000001")


@query
def notes_by_ids(s, d):
    return tasks.by_ids(bound.notes(s, d), ["n0000000005", "n9999999999", "n0000000001", "n0000000005"])


@query
def program_roots(s, d):
    c = bound.corpus(s, d)
    return tasks.program_roots(replace(c, edges=c.edges.where("not (kind = 'results_in' and endswith(dst, '0'))")), "src/src10/**")


@query
def task_roles(s, d):
    return tasks.roles(bound.corpus(s, d))


@query
def task_modes(s, d):
    c = bound.corpus(s, d)
    return tasks.modes(replace(c, events=c.events.where("event_id % 7 = 0")))


@query
def task_contexts(s, d):
    c = bound.corpus(s, d)
    out = tasks.contexts(c, c.notes.where("doc_id % 50 = 1").select("id"))
    return out.select("id", "relation", "other", text.one_line("statement").alias("statement"), "scope", "status", "total", "done")


@query
def agent_memory(s, d):
    return tasks.agent_memory(bound.notes(s, d), "agent3", limit=40).select("id", "agent_id", "created_ms")


@query
def work_by_status(s, d):
    return tasks.still_to_do(bound.corpus(s, d))


@query
def epics_around(s, d):
    c = bound.corpus(s, d)
    return graph.epic_around(replace(c, edges=c.edges.where("not (kind = 'results_in' and endswith(dst, '1'))")))


@query
def manifest_counters(s, d):
    return handoff.counters(bound.corpus(s, d), PATHS)


@query
def rewind_scope(s, d):
    return handoff.rewind(bound.corpus(s, d), "scope", SCOPE, budget=400)


@query
def rewind_resume(s, d):
    """A hand-off given out before, after another one was."""
    c = bound.corpus(s, d)
    contexts = handoff.Contexts(s, f"{shared_dir(s)}/contexts-{uuid.uuid4().hex[:12]}")
    first = contexts.save(handoff.rewind(c, "scope", SCOPE, budget=400))
    contexts.save(handoff.rewind(c, "scope", SCOPE, budget=200))
    return contexts.resume(first)


@query
def rewind_files(s, d):
    return handoff.rewind(bound.corpus(s, d), "files", paths=tuple(PATHS), budget=4000)


@query
def rewind_auto(s, d):
    return handoff.rewind(bound.corpus(s, d), "auto", paths=tuple(PATHS), budget=900)


@query
def refs_annotated(s, d):
    return handoff.annotated(_lines(s, d), _hashed(bound.notes(s, d)).where("doc_id % 4 <> 0"), _files(s, d).where("endswith(path, '1.rs')"))


@query
def refs_verified(s, d):
    lines = handoff.annotated(_lines(s, d), _hashed(bound.notes(s, d)), _files(s, d).where("endswith(path, '1.rs')"))
    now = _hashed(bound.notes(s, d).withColumn("body", F.when(F.col("doc_id") % 50 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))).where("doc_id % 75 <> 0")
    return handoff.verified(lines, now, _files(s, d).where("not endswith(path, '21.rs')"), _changed_files(s, d))


@query
def stale_anchors(s, d):
    n = bound.notes(s, d).withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "body", F.array_join("anchors", " "))).otherwise(F.col("body")))
    return handoff.stale_anchors(handoff.anchor_records(n, _files(s, d)), _changed_files(s, d))


@query
def audit(s, d):
    c = bound.corpus(s, d)
    suggested = c.notes.where("doc_id % 20 = 0").select(F.col("id").alias("src"), _note("doc_id * 3 + 1").alias("dst"))
    locks = s.createDataFrame([("a.lock", c.now_ms - 600_000), ("b.lock", c.now_ms - 60_000)], "path string, taken_ms long")
    return handoff.audit(c, suggested, locks, 300_000)


@query
def edge_mentions(s, d):
    n = bound.notes(s, d).where("type is not null")
    own = F.concat(F.col("type"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    known = n.select(own.alias("target"))
    cues = F.array(*[F.lit(x) for x in ("Depende de", "isto requer", "que contradiz", "veja [[", "confirma", "ver")])
    said = F.concat(F.element_at(cues, (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), F.lit("fact_"), F.lpad((F.col("doc_id") - F.col("doc_id") % 10).cast("string"), 8, "0"))
    body = F.concat_ws("", F.left("body", F.lit(80)), F.lit(" e substitui "), own, F.lit(", "), said, F.lit("x e refina def_"), F.lpad((F.col("doc_id") - F.col("doc_id") % 10 + 5).cast("string"), 8, "0"), F.lit("."))
    found = n.select("id", F.explode(text.mentions(body, TYPES)).alias("m")).select("id", "m.target", "m.kind", "m.reason").distinct()
    return found.join(known, "target", "left_semi")


@query
def closest_labels(s, d):
    words = bound.notes(s, d).where("type is not null").select(F.concat(F.left("type", F.length("type") - F.col("doc_id") % 3), F.lit("s")).alias("raw")).distinct()
    return words.select("raw", text.closest("raw", TYPES).alias("hint"))


@query
def parent_markers(s, d):
    n = bound.notes(s, d)
    body = F.when(F.col("doc_id") % 3 == 0, text.with_marker("body", _note("doc_id DIV 3"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9).cast("int"))).otherwise(F.col("body"))
    rows = n.select("id", body.alias("marked"))
    return rows.select("id", text.parent_marker("marked")["parent"].alias("parent"), text.parent_marker("marked")["blocks"].cast("long").alias("blocks"), F.md5(F.encode(text.without_marker("marked"), "UTF-8")).alias("rest"))


@query
def outcomes_appended(s, d):
    n = bound.notes(s, d).withColumn("outcomes", F.expr("cast(array() as array<struct<status: string, recorded_ms: bigint, notes: string, duration: bigint, agent: string>>)")).withColumn("revision", F.lit(1))
    results = bound.events(s, d).where("op = 'task' and action = 'review'").select(F.col("note_id").alias("id"), F.lit("success").alias("status"), F.col("at").alias("recorded_ms"), F.col("event_id").cast("string").alias("notes"))
    out = writes.outcomes_appended(n, results)
    return out.select("id", F.col("revision").cast("long").alias("revision"), F.array_join(F.transform("outcomes", lambda x: F.concat_ws(":", x["status"], x["recorded_ms"].cast("string"), x["notes"])), ",").alias("outcomes"))


@query
def draft_problems(s, d):
    i = F.col("doc_id")
    kind = F.when(i % 11 == 2, "fakt").otherwise(F.col("type"))
    said = F.when(i % 13 == 3, F.lit("")).otherwise(F.col("id"))
    json = F.when(i % 17 == 4, F.lit("[1]")).otherwise(F.to_json(F.struct(kind.alias("type"), said.alias("statement"), F.when(i % 19 == 5, "late").otherwise(F.col("status")).alias("status"))))
    drafts = bound.notes(s, d).select(F.col("id").alias("draft_id"), F.when((i % 7 == 1) & (i % 17 != 4), F.regexp_replace(json, r"\}$", ',"titel":"x"}')).otherwise(json).alias("json"))
    return writes.draft_problems(drafts)


@query
def checks_resolved(s, d):
    explicit = s.createDataFrame([("fmt",), ("lint",), ("nowhere",)], "name string")
    catalog = s.createDataFrame([("fmt", None), ("all", None), ("lint", "src/src1/**"), ("one", "src/src1/doc_1.rs"), ("none", "docs/*.md"), ("two", "src/*/doc_2?.rs")], "name string, scope string")
    return flow.resolved_checks(explicit, catalog, filters.anchors_of(bound.notes(s, d), "anchor").select("anchor"))


@query
def check_outcomes(s, d):
    e = bound.events(s, d)
    results = e.select("note_id", F.when(F.col("event_id") % 10 > 0, F.col("event_id") % 5 > 0).alias("passed"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning").alias("severity"))
    return flow.outcome(results)


@query
def gates_accepted(s, d):
    n = bound.notes(s, d)
    gates = n.select(F.col("id").alias("name"), (F.col("doc_id") % 4 > 0).alias("passed"), (F.col("doc_id") % 7).cast("double").alias("before"), (F.col("doc_id") % 9).cast("double").alias("after"))
    return flow.accepted(gates, 1.0)


@query
def transitions(s, d):
    """How many notes could go from their status to each other one, as notes and as tasks."""
    names = ["active", "in_progress", "blocked", "closed", "superseded", "forgotten"]
    pairs = bound.notes(s, d).select(F.col("status").alias("source"), F.explode(F.array(*map(F.lit, names))).alias("target"))
    rule = lambda f: F.count_if(f(F.col("source"), F.col("target")))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"), rule(filters.transition_allowed).alias("note"), rule(filters.task_transition_allowed).alias("task"))


@query
def hierarchy(s, d):
    n = bound.notes(s, d).select("id", "scope")
    up = graph.parents(bound.edges(s, d)).join(n.toDF("id", "child"), "id").join(n.toDF("parent", "above"), "parent")
    return up.select("id", filters.hierarchy_allowed(F.col("above"), F.col("child")).alias("allowed"))


@query
def demotions_covered(s, d):
    c = bound.corpus(s, d)
    plan = c.notes.select("id", F.when(F.col("doc_id") % 2 == 0, "anchor_decay").otherwise("expired").alias("reason"))
    return lifecycle.covered(plan, lifecycle.anchor_validity(c.notes, c.paths.where("substr(md5(path), 1, 1) < '8'")), 0.5)


@query
def drift_index(s, d):
    e = bound.events(s, d)
    return lifecycle.latest_drift(e.select(F.col("note_id").alias("id"), F.col("event_id").alias("seq"), ((F.col("at") % 1000) / 1000.0).alias("drift")))


@query
def edges_missing(s, d):
    suggested = bound.notes(s, d).where("doc_id % 8 = 0").select(F.col("id").alias("src"), _note("(doc_id * 13 + 7) % (doc_id DIV 2 + 1)").alias("dst"))
    extra = bound.notes(s, d).where("doc_id % 8 = 1").select("id", _note("doc_id * 5"))
    return graph.missing_edges(bound.edges(s, d), suggested.union(extra))


@query
def events_since(s, d):
    e = bound.events(s, d).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), (F.col("event_id") % 3).alias("_segment"), F.col("event_id").alias("_line"))
    return since(e, "e502").select("id")


@query
def status_changes(s, d):
    n = bound.notes(s, d)
    targets = F.element_at(F.array(*map(F.lit, ("closed", "active", "superseded", "forgotten"))), (F.col("doc_id") % 4 + 1).cast("int"))
    after, refused = writes.changed_status(n, n.where("doc_id % 3 = 0").select("id", targets.alias("target")))
    return after.select("id", "status").join(refused.select("id", F.col("target").alias("refused")), "id", "left")


@query
def notes_updated(s, d):
    n = bound.notes(s, d).where("type is not null").withColumn("revision", F.lit(3))
    none = F.lit(None).cast("string")
    p = n.where("doc_id % 6 in (2, 4)").select("id", none.alias("type"), F.when(F.col("doc_id") % 6 == 2, F.concat(F.lit("new "), "statement")).alias("statement"), F.lit("b").alias("body"))
    return writes.updated(n, p).select("id", "new_id", "action", "status", F.col("revision").cast("long").alias("revision"))


@query
def notes_merged(s, d):
    n = bound.notes(s, d)
    more = n.where("doc_id % 30 = 0").select(_note("doc_id DIV 2").alias("target"), F.array(F.lit("zz"), F.lit("en")).alias("tags"), "anchors", F.left("body", F.lit(40)).alias("body"))
    out = writes.merged(n, more)
    return out.select("id", F.array_join("tags", ",").alias("tags"), F.array_join("anchors", ",").alias("anchors"), F.md5(F.encode("body", "UTF-8")).alias("body"))


@query
def links_added(s, d):
    e = bound.edges(s, d)
    new = bound.notes(s, d).where("doc_id % 12 = 0").select(F.col("id").alias("src"), F.when(F.col("doc_id") % 24 == 0, "supports").otherwise("likes").alias("kind"), _note("doc_id * 2").alias("dst"))
    after, refused = writes.linked(e, new)
    return after.groupBy("kind").agg(F.count("*").alias("n")).union(refused.groupBy(F.concat(F.lit("refused "), "kind").alias("kind")).agg(F.count("*").alias("n")))


@query
def statement_pairs_mixed(s, d):
    return dedup.statement_proposals(bound.notes(s, d)).select("keep", "drop", _r("score"))


@query
def merge_strategy(s, d):
    return dedup.merge_proposals(bound.notes(s, d)).select("keep", "drop", _r("score"))


@query
def hints(s, d):
    n = bound.notes(s, d)
    return writes.hints(n.where("doc_id % 10 = 1").select("id", (F.col("doc_id") % 5).alias("priority")), n.where("doc_id % 30 = 1").select("id"), 7)


@query
def unlinked_by_reference(s, d):
    c = bound.corpus(s, d)
    return semantic.unlinked(c.vectors, graph.of_kind(c.edges, "extends", "supports"))
