"""Upkeep of the whole store: the thirteen checks of its health, and removal of what has been retired long enough."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.corpus import Corpus, Settings
from lorewell.functions.globs import either_matches, to_regex
from lorewell.functions.ids import body_hash
from lorewell.functions.runtime import written
from lorewell.functions.text import missing_slots
from lorewell.operators.dedup import merge_proposals
from lorewell.operators.graph import cyclic, integrity, of_kind, parents
from lorewell.operators.lifecycle import retirements

#: Bytes of an index or cache of vectors from which it is reported.
EMBEDDING_BYTES = 50 << 20
PROGRAMS = "plan/*.md"


@dataclass(frozen=True)
class Store:
    """What lies beside the corpus. Each table may be missing: then its check finds nothing.

    skipped (id): notes that could not be read. records (path, content_hash): anchors as last seen; files (path, content_hash): those there are now.
    locks (path, taken_ms). bad_events: lines of the log that are no events. hashes (id, body_hash): as the notes state them.
    derived (id, digest): what an index holds of the notes; ``canonical`` (id, digest): what it should hold.
    """

    skipped: DataFrame | None = None
    records: DataFrame | None = None
    files: DataFrame | None = None
    locks: DataFrame | None = None
    bad_events: DataFrame | None = None
    hashes: DataFrame | None = None
    derived: DataFrame | None = None
    canonical: DataFrame | None = None
    embedding_bytes: tuple[int, int] = (0, 0)
    lock_stale_ms: int = 60_000
    programs: str = PROGRAMS
    wrong_settings: tuple[str, ...] = field(default=())


def wrong_settings(s: Settings) -> tuple[str, ...]:
    """Names of settings that contradict themselves or each other."""
    rules = {
        "create_below": 0 <= s.create_below <= s.merge_below, "merge_below": s.merge_below <= 1, "limit": s.limit > 0, "rrf_k": s.rrf_k > 0, "confirmation": 0 <= s.confirmation <= 1, "max_term_ratio": 0 <= s.max_term_ratio <= 1,
        "link_low": 0 <= s.link_low <= s.link_high, "link_high": s.link_high <= 1, "promote_confidence": 0 <= s.promote_confidence <= 1, "ttl": min(s.ttl) >= 0, "retired_days": s.retired_days >= 0,
        "anchor_threshold": 0 <= s.anchor_threshold <= 1, "cluster_similarity": 0 <= s.cluster_similarity <= 1, "batch": s.batch > 0, "budget": s.budget > 0,
    }
    return tuple(k for k, ok in rules.items() if not ok)


def differing(canonical: DataFrame, derived: DataFrame) -> DataFrame:
    """(id): missing on one side, or with another digest."""
    rows = canonical.select("id", F.col("digest").alias("_a")).join(derived.select("id", F.col("digest").alias("_b")), "id", "full")
    return rows.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("id")


def without_program(corpus: Corpus, files: DataFrame | None, programs: str) -> DataFrame:
    """(id): root epics that no program file anchors, and program files that no root epic is anchored at."""
    roots = corpus.notes.where("scope = 'epic'").join(parents(corpus.edges), "id", "left_anti")
    missing = roots.where(~F.coalesce(F.exists("anchors", lambda a: either_matches(a, F.lit(programs))), F.lit(False))).select("id")
    if files is None:
        return missing
    there = files.where(F.rlike("path", F.lit(to_regex(programs)))).select("path").distinct()
    anchors = roots.select(F.explode("anchors").alias("anchor")).distinct()
    from lorewell.operators.filters import anchor_pairs

    held = anchor_pairs(anchors, there).select(F.col("b").alias("path")).distinct()
    return missing.union(there.join(held, "path", "left_anti").select(F.col("path").alias("id")))


def bare_bodies(corpus: Corpus) -> DataFrame:
    """(id, blank, slots) of live notes of knowledge with a blank body or without what their kind needs."""
    degree = corpus.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_e"))
    work = (F.coalesce("type", F.lit("")) == "task") | (F.coalesce("scope", F.lit("")) == "epic")
    live = corpus.notes.where(~work & ~F.col("status").isin("superseded", "forgotten")).join(degree, "id", "left")
    slots = F.coalesce(missing_slots(F.col("type"), F.col("body"), F.size("anchors"), F.coalesce("_e", F.lit(0))), F.array().cast("array<string>"))
    rows = live.select("id", F.coalesce(F.trim("body") == "", F.lit(True)).alias("blank"), slots.alias("slots"))
    return rows.where(F.col("blank") | (F.size("slots") > 0))


def doctor(corpus: Corpus, store: Store) -> DataFrame:
    """(check, findings, ok, fixable): the thirteen checks, each one row."""
    spark = corpus.notes.sparkSession
    nothing = spark.range(0)
    some = lambda df: nothing if df is None else df
    drifted = stated = derived = None
    if store.records is not None and store.files is not None:
        now = store.files.select("path", F.col("content_hash").alias("_now"))
        drifted = store.records.select("path", "content_hash").distinct().join(now, "path", "left").where("_now is null or _now <> content_hash")
    if store.hashes is not None:
        own = corpus.notes.select("id", body_hash(F.col("statement"), F.col("body")).alias("_h"))
        stated = own.join(store.hashes.select("id", "body_hash"), "id").where("body_hash is not null and body_hash <> _h")
    if store.canonical is not None and store.derived is not None:
        derived = differing(store.canonical, store.derived)
    stale = None if store.locks is None else store.locks.where(F.lit(corpus.now_ms) - F.col("taken_ms") >= store.lock_stale_ms)
    settings = store.wrong_settings + wrong_settings(corpus.settings)
    large = sum(b > EMBEDDING_BYTES for b in store.embedding_bytes)
    checks = [
        ("schema", some(store.skipped), False), ("integrity", integrity(corpus), False), ("cycles", cyclic(of_kind(corpus.edges, "depends_on")), False), ("anchors", some(drifted), True),
        ("program_anchor", without_program(corpus, store.files, store.programs), False), ("duplicates", merge_proposals(corpus.notes), False), ("locks", some(stale), True), ("config", spark.range(len(settings)), False),
        ("body_hash", some(stated), True), ("events", some(store.bad_events), False), ("derived", some(derived), True), ("embeddings", spark.range(large), False), ("body", bare_bodies(corpus), False),
    ]
    out = None
    for name, rows, fixable in checks:
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("findings"), (F.count("*") == 0).alias("ok"), F.lit(fixable).alias("fixable"))
        out = one if out is None else out.union(one)
    return out


def due(corpus: Corpus) -> DataFrame:
    """(id, retired_at, reason) of the notes to remove: retired long enough by the log, not restored since, and in no cycle of dependencies."""
    back = corpus.events.where("op = 'restore'").groupBy(F.col("note_id").alias("id")).agg(F.max(F.struct("at", "event_id")).alias("_back"))
    last = corpus.events.where(F.col("op").isin("forget", "supersede") & F.col("note_id").isNotNull()).groupBy(F.col("note_id").alias("id")).agg(F.max(F.struct("at", "event_id")).alias("_last"))
    restored = last.join(back, "id").where("_back > _last").select("id")
    rows = retirements(corpus).where("due").join(corpus.notes.select("id"), "id", "left_semi").join(restored, "id", "left_anti")
    return rows.join(cyclic(of_kind(corpus.edges, "depends_on")).select("id"), "id", "left_anti").select("id", "retired_at", "reason")


def purged(corpus: Corpus) -> tuple[Corpus, DataFrame]:
    """The corpus without the notes that are due, and what went: (id, retired_at, reason, links, pointers).

    Links from and to them and vectors of theirs go too, and superseded_by of other notes that names them is cleared; the log stays.
    Everything is an anti-join, so derived tables are treated alike by ``without``.
    """
    gone = written(due(corpus))
    ids = gone.select("id")
    ends = corpus.edges.select(F.col("src").alias("id")).union(corpus.edges.where("src <> dst").select("dst"))
    links = ends.groupBy("id").agg(F.count("*").alias("links"))
    named = corpus.notes.join(ids, "id", "left_anti").where(F.col("superseded_by").isNotNull()).groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("pointers"))
    told = gone.join(links, "id", "left").join(named, "id", "left").select("id", "retired_at", "reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "pointers")])
    cut = ids.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_cut"))
    notes = corpus.notes.join(ids, "id", "left_anti").join(cut, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("_cut").isNull(), F.col("superseded_by"))).select(*corpus.notes.columns)
    edges = without(without(corpus.edges, ids, "src"), ids, "dst").select(*corpus.edges.columns)
    vectors = None if corpus.vectors is None else without(corpus.vectors, ids, "id")
    return replace(corpus, notes=notes, edges=edges, vectors=vectors), told


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")
