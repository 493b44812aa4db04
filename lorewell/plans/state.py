"""Queries on persisted state: indexes, caches, logs and what follows from them, over the bound corpus."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lorewell.functions.ids import body_hash
from lorewell.functions.runtime import shared_dir
from lorewell.operators import batch, confidence, flow, graph, paths, retrieval, revisions, scope, semantic, upkeep
from lorewell.operators.filters import Filter
from lorewell.plans.catalogue import QUERY, query
from lorewell.plans.work import _changed_files, _files, _note
from lorewell.sources import bound, cache, logs
from lorewell.sources.indexes import TermIndex, digest

CACHE_BYTES, LOG_BYTES = 100_000, 1 << 16


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex[:12]}"


@query
def bm25_index(s, d):
    """The ranking of ``bm25_topk`` from an index that was built over other notes and texts, refreshed twice and compacted once."""
    notes = bound.notes(s, d)
    before = notes.where("doc_id % 5 <> 2").withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("kernel data "), "body")).otherwise(F.col("body")))
    more = before.select("id", "type", "statement", "body", "tags", "successes").union(s.createDataFrame([("gone", "fact", QUERY, QUERY, ["en"], 1.0)], "id string, type string, statement string, body string, tags array<string>, successes double"))
    index = TermIndex(s, _folder(s, "terms"))
    index.refresh(more)
    index.refresh(notes.where("doc_id % 7 <> 1"))
    index.compact()
    index.refresh(notes)
    return retrieval.top(index.bm25(notes, QUERY).select("id", "score"), "score", 20)


def entries(s, d):
    """Cache entries of all vectors, a third of them made twice."""
    v = s.read.parquet(f"{d}/embeddings.parquet")
    row = lambda made, scale: v.select(
        F.md5(F.col("vec_id").cast("string")).alias("body_hash"), F.concat(F.lit("model"), (F.col("vec_id") % 3).cast("string")).alias("model"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("vector"),
        made.alias("created_ms"), (F.col("vec_id") * 7919 % 1000).cast("long").alias("used_ms"),
    )
    return row(F.col("vec_id") % 10, 1.0), row(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 10).otherwise(F.lit(5).cast("long")), 2.0)


@query
def cache_kept(s, d):
    old, new = entries(s, d)
    merged = cache.merged(old, new, CACHE_BYTES)
    out = cache.fitting(cache.unexpired(merged, 9, 7), CACHE_BYTES)
    return out.select("body_hash", "model", "created_ms", "used_ms", F.round(F.element_at("vector", 1), 6).alias("first_value"))


def log(s, d):
    e = bound.events(s, d)
    data = F.map_filter(F.create_map(*[x for c in ("action", "dst", "kind") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return e.select(F.format_string("ev-%010d", "event_id").alias("id"), "op", "note_id", "at", data.alias("data"))


@query
def event_segments(s, d):
    """The segments of a log of all events, cut at LOG_BYTES."""
    rows = logs.segmented(log(s, d), LOG_BYTES)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min_by("id", F.struct("at", "id")).alias("first_id"), F.max_by("id", F.struct("at", "id")).alias("last_id"))


@query
def knn_by_index(s, d):
    """Five neighbours of every 50th vector from the inverted file; its recall against the exact search is tested."""
    v = bound.vectors(s, d)
    return semantic.VectorIndex(v).search(v.where("substr(id, 10) in ('00', '50')"), 5, 0.0).select("origin", "id", "score")


@query
def histories(s, d):
    """The history of every note that replaces another or is superseded."""
    edges, notes = bound.edges(s, d), bound.notes(s, d)
    starts = edges.where("kind = 'replaces'").select(F.col("src").alias("id")).union(notes.where("superseded_by is not null").select("id")).distinct()
    return paths.history(edges, notes, starts)


@query
def critical_chain(s, d):
    """The nodes of the longest chains: from each task that starts one of the longest sum, place by place."""
    c = bound.corpus(s, d)
    lead = flow.task_flows(c.events).select("id", (F.coalesce("closed_ms", F.lit(c.now_ms)) - F.col("created_ms")).alias("duration"))
    best = graph.critical_path(graph.of_kind(c.edges, "depends_on"), lead.join(c.notes.select("id"), "id", "left_semi"))
    top = best.agg(F.max("n").alias("n"))
    return paths.chains(best.select("id", "next"), best.join(F.broadcast(top), "n", "left_semi").select("id")).select("start", "position", "id")


def store(s, d) -> upkeep.Store:
    """A store that has something wrong of each kind, by rules over all rows."""
    notes, events = bound.notes(s, d), log(s, d)
    line = F.to_json(F.struct("at", "data", "id", "note_id", "op"))
    broken = F.col("id").endswith("3")
    lines = events.select(F.when(broken & (F.col("op") == "forget"), F.left(line, F.lit(20))).when(broken & (F.col("op") == "write"), F.lit('{"at":1,"id":"x"}')).otherwise(line).alias("value"))
    canonical = notes.select("doc_id", "id", digest().alias("digest"))
    derived = canonical.where("doc_id % 17 <> 0").select("id", F.when(F.col("doc_id") % 19 == 0, "other").otherwise(F.col("digest")).alias("digest"))
    return upkeep.Store(
        skipped=s.read.parquet(f"{d}/documents.parquet").where("coalesce(text, '') = ''"), records=_files(s, d), files=_changed_files(s, d), locks=bound.events(s, d).where("op = 'write'").select(F.col("note_id").alias("path"), F.col("at").alias("taken_ms")),
        bad_events=logs.malformed(lines), hashes=notes.select("id", F.when(F.col("doc_id") % 13 == 0, "stale").otherwise(body_hash(F.col("statement"), F.col("body"))).alias("body_hash")),
        derived=derived, canonical=canonical.select("id", "digest"), embedding_bytes=(0, upkeep.EMBEDDING_BYTES + 1), programs="src/*/doc_1.rs",
    )


@query
def doctor_store(s, d):
    c = bound.corpus(s, d)
    return upkeep.doctor(replace(c, settings=replace(c.settings, limit=0)), store(s, d))


@query
def purge_due(s, d):
    return upkeep.purged(bound.corpus(s, d))[1]


@query
def purge_left(s, d):
    """What is left after the purge, and how many of the links left lead to or from a note that went."""
    c = bound.corpus(s, d)
    left, told = upkeep.purged(c)
    ends = left.edges.select(F.col("src").alias("id")).union(left.edges.select("dst")).union(left.notes.select("superseded_by")).union(left.vectors.select("id"))
    count = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return count("notes", left.notes).union(count("links", left.edges)).union(count("vectors", left.vectors)).union(count("pointers", left.notes.where("superseded_by is not null"))).union(count("dangling", ends.join(told.select("id"), "id", "left_semi")))


def operations(s, d):
    """A batch with a line for every note: changes, new notes, parents by key and by id, and wrong ones of each kind."""
    i = F.col("doc_id")
    own = F.when(i % 3 == 0, _note("doc_id")).when(i % 41 == 5, "n9999999999")
    parent = F.when(i % 5 == 1, F.concat(F.lit("k"), (i - 1).cast("string"))).when(i % 5 == 2, _note("doc_id - 2")).when(i % 5 == 3, F.concat(F.lit("k"), (i + 1).cast("string"))).when(i % 5 == 4, _note("doc_id * 8 + 1"))
    scope = F.when(own.isNull(), F.when(i % 7 == 1, "issue").when(i % 7 == 2, "epic").when(i % 7 == 5, "odd").otherwise("task"))
    return s.read.parquet(f"{d}/documents.parquet").select(
        i.alias("line"), F.concat(F.lit("k"), i.cast("string")).alias("key"), own.alias("id"), F.lit("task").alias("type"), scope.alias("scope"), F.when(i % 37 == 4, " ").otherwise(F.concat(F.lit("new item "), i.cast("string"))).alias("statement"), parent.alias("parent")
    )


@query
def task_batch(s, d):
    return batch.checked(bound.corpus(s, d), operations(s, d)).select("line", "action", "target", "scope", "parent_id", "problem")


def _ontology(s, d):
    """The bound links with narrower ones beside the broader, some of which close cycles."""
    i = F.col("doc_id")
    ids = s.read.parquet(f"{d}/documents.parquet")
    narrower = ids.where("doc_id % 30 = 11 and doc_id > 30").select(_note("doc_id DIV 2").alias("src"), F.lit("narrower").alias("kind"), _note("doc_id").alias("dst"))
    back = ids.where(i % 90 == 9).select(_note("doc_id").alias("src"), F.lit("narrower").alias("kind"), _note("doc_id DIV 3").alias("dst"))
    return bound.edges(s, d).union(narrower).union(back)


@query
def broader_narrower(s, d):
    return graph.hierarchy(_ontology(s, d))


@query
def hierarchy_cycles(s, d):
    return graph.hierarchy_cycles(_ontology(s, d))


@query
def link_suggestions(s, d):
    v = bound.vectors(s, d)
    return semantic.link_suggestions(v, bound.edges(s, d), v.where("substr(id, 10) in ('00', '50')"), 8, 0.2)


@query
def confirmed_around(s, d):
    """What tasks confirm of the notes near one note, of two languages."""
    c = scope.scoped(bound.corpus(s, d), scope.Scope(Filter(tags=("en", "de")), around="n0000000010", depth=3), "rank")
    return c.notes.select("id", "status").join(confidence.task_confirmation(bound.notes(s, d)), "id", "left").select("id", "status", F.round(F.coalesce("task", F.lit(0.0)), 6).alias("task"))


def _patched(s, d) -> revisions.Outcome:
    """A patch for every note: bodies, statements that make new notes, two that make the same one, unknown notes, right and wrong hashes."""
    i = F.col("doc_id")
    notes = bound.notes(s, d).withColumn("revision", (i % 4).cast("int"))
    statement = F.when(i % 12 == 2, F.concat(F.lit("twin "), (i / 24).cast("int").cast("string"))).when(i % 4 == 1, F.concat(F.lit("changed "), i.cast("string")))
    patches = notes.select(
        i.alias("line"), F.when(i % 29 == 7, "n9999999999").otherwise(F.col("id")).alias("id"), F.lit(None).cast("string").alias("type"), statement.alias("statement"), F.when(i % 3 == 0, "new body").alias("body"),
        F.when(i % 5 == 0, "wrong").when(i % 5 == 1, body_hash(F.col("statement"), F.col("body"))).alias("expected_hash"),
    )
    return revisions.updated(notes, bound.edges(s, d), patches, bound.NOW_MS)


@query
def update_outcomes(s, d):
    return _patched(s, d).outcomes


@query
def update_effects(s, d):
    """Notes by status, links by kind and events by kind after the patches."""
    o = _patched(s, d)
    count = lambda df, what, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
    return count(o.notes, "status", "status").union(count(o.edges, "kind", "kind")).union(count(o.events, "op", "op"))
