"""Hand-off: counters, choice of a scope, dispatch, references with hashes, anchors' contents, and the audit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.globs import has_glob, regex_column
from lorewell.functions.ids import base36
from lorewell.functions.runtime import running, written
from lorewell.functions.text import one_line, token_estimate
from lorewell.operators.dedup import merge_proposals
from lorewell.operators.filters import actionable, anchors_of
from lorewell.operators.flow import MIN_TAIL, manifest, next_tasks, scope_counts
from lorewell.operators.graph import cyclic, in_scope, in_scopes, integrity, missing_edges, of_kind, views
from lorewell.operators.lifecycle import freshness
from lorewell.operators.tasks import program_roots
from lorewell.sources.versions import Versions

FLIP_NOTES, FLIP_CONTAINERS = 100, 5
# How a line names an anchor's contents, and what stands between a name and its hash.
ANCHOR_LINE, SEPARATOR = "anchor|", "@"


def counters(corpus: Corpus, changed: list[str]) -> DataFrame:
    """One row: notes, ready, blocked, containers, dirty, and the ids of the three newest notes."""
    state = views(corpus).agg(F.count_if(F.col("state") == "ready").alias("ready"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    newest = corpus.notes.select("id", "created_ms").orderBy(F.desc("created_ms"), "id").limit(3)
    recent = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("created_ms")).alias("t"), "id"))), lambda x: x["id"]), " ").alias("recent"))
    all_ = corpus.notes.agg(F.count("*").alias("notes"), F.count_if(F.col("scope") == "epic").alias("containers"))
    one = F.lit(True)
    return all_.join(F.broadcast(state), one).join(F.broadcast(recent), one).select("notes", "ready", "blocked", "containers", F.lit("dirty" if changed else "clean").alias("dirty"), "recent")


def detected_scope(corpus: Corpus, changed: list[str]) -> str | None:
    """The epic most of whose members' anchors match the changed paths; the smaller id at a tie."""
    best = scope_counts(corpus, changed).orderBy(F.desc("hits"), "epic").first()
    return best.epic if best else None


def effective_mode(corpus: Corpus, mode: str, changed: list[str]) -> tuple[str, str | None]:
    """(mode, container): auto is the manifest of a large corpus, else the scope of the changed paths where there is one."""
    if mode != "auto":
        return mode, None
    size = corpus.notes.agg(F.count("*").alias("n"), F.count_if(F.col("scope") == "epic").alias("epics")).first()
    container = None if size.n > FLIP_NOTES or size.epics > FLIP_CONTAINERS else detected_scope(corpus, changed)
    return ("scope", container) if container else ("manifest", None)


def ranked_items(corpus: Corpus, mode: str, container: str | None = None, paths: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, created_ms, line) of a scope's members, or of what the files touch: notes anchored at them and members of the programs they are of.

    Foundational notes and decisions bring their bodies.
    """
    rows = manifest(corpus)
    if mode == "scope":
        rows = rows.join(in_scope(corpus, container), "id", "left_semi")
    else:
        touched = lambda a: sum((F.rlike(F.lit(p), regex_column(a)).cast("int") for p in paths), F.lit(0)) > 0
        hit = corpus.notes.where(F.exists("anchors", touched)).select("id")
        for p in paths:  # a short list of files
            hit = hit.union(in_scopes(corpus, program_roots(corpus, p)))
        rows = rows.join(hit.distinct(), "id", "left_semi")
    rich = (F.col("classification") == "foundational") | (F.col("type") == "decision")
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    own = corpus.notes.select("id", F.when(rich & (F.coalesce(body, F.lit("")) != ""), F.concat(F.lit("\n"), body)).otherwise("").alias("_body"))
    line = F.concat(F.concat_ws("|", "id", one_line("statement"), "tier"), "_body")
    return rows.join(own, "id").select("id", "score", "created_ms", line.alias("line"))


def cut(items: DataFrame, budget: int) -> DataFrame:
    """(position, line, truncated, dropped) of ranked items within a token budget; the line that overflows is cut if enough is left.

    An item costs a token at least, so ``budget`` + 1 of them decide; dropped counts all that are not whole.
    """
    order = [F.desc("score"), F.desc("created_ms"), F.col("id")]
    best = items.orderBy(*order).limit(budget + 1).withColumn("_cost", token_estimate("line").cast("long"))
    rows = running(best, "_cost", *order)
    whole = F.col("before") + F.col("_cost") <= budget
    first = rows.where(~whole).agg(F.min("position").alias("_first"))
    left = F.lit(budget) - F.col("before")
    rows = rows.join(F.broadcast(first), F.lit(True)).join(F.broadcast(items.agg(F.count("*").alias("_n"))), F.lit(True))
    at = F.col("_first").isNotNull() & (F.col("position") == F.col("_first")) & (left >= MIN_TAIL)
    kept = rows.where(F.col("_first").isNull() | (F.col("position") < F.col("_first")) | at)
    line = F.when(at, F.concat(F.substring(F.col("line"), F.lit(1), (left * 4).cast("int")), F.lit("…"))).otherwise(F.col("line"))
    truncated = F.max(at).over(W.partitionBy("_n"))  # of the report's own lines, a budget's worth
    return kept.select("position", line.alias("line"), truncated.alias("truncated"), F.coalesce(F.col("_n") - F.col("_first"), F.lit(0)).alias("dropped"))


def manifest_lines(corpus: Corpus, changed: list[str], budget: int, pending: int = 0) -> DataFrame:
    """(position, line, truncated, dropped): counters, newest notes, next tasks, freshness; dropped counts ready tasks that are not shown."""
    c, f = counters(corpus, changed), freshness(corpus)
    shown = next_tasks(corpus, budget=budget)
    order = F.struct((-F.col("impact")).alias("i"), "created_ms", "id")
    tasks = shown.withColumn("created_ms", F.coalesce("created_ms", F.lit(0))).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws("|", "id", "statement").alias("t")))), lambda x: x["t"]), " ").alias("next"), F.count("*").alias("_shown"))
    ready = views(corpus).where("state = 'ready'").select("id").join(corpus.notes.where(actionable()).select("id"), "id", "left_semi").agg(F.count("*").alias("_ready"))
    one = F.lit(True)
    row = c.join(F.broadcast(f.select("stale", "expiring")), one).join(F.broadcast(tasks), one).join(F.broadcast(ready), one)
    lines = F.array(
        F.format_string("notes=%d ready=%d blocked=%d containers=%d %s", "notes", "ready", "blocked", "containers", "dirty"), F.concat(F.lit("recent: "), "recent"),
        F.when(F.col("_shown") > 0, F.concat(F.lit("next: "), "next")), F.format_string("fresh: stale=%d expiring=%d pending=%d", "stale", "expiring", F.lit(pending)),
    )
    out = row.select(F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("position", "line"), F.lit(False).alias("truncated"), (F.col("_ready") - F.col("_shown")).alias("dropped"))
    return out.withColumn("position", F.col("position").cast("long"))


def rewind(corpus: Corpus, mode: str = "auto", container: str | None = None, paths: tuple[str, ...] = (), budget: int = 4000) -> DataFrame:
    """(position, line, truncated, dropped): the hand-off of a scope, of files, or the manifest."""
    mode, found = effective_mode(corpus, mode, list(paths))
    if mode == "manifest":
        return manifest_lines(corpus, list(paths), budget)
    return cut(ranked_items(corpus, mode, container or found, paths), budget)


class Contexts:
    """Hand-offs that were given out, below ``path``, by what they say: equal ones have one id."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path)

    def save(self, lines: DataFrame) -> str:
        """Keep lines (position, line), a budget's worth, and give their id."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
        found = written(lines.select("position", "line"))
        name = found.agg(F.concat(F.lit("ctx_"), base36(text)).alias("id")).first().id
        number, manifest = self.versions.current()
        if name not in manifest["tables"]:
            self.versions.commit(number, manifest | {"tables": manifest["tables"] | {name: [self.versions.part(found.coalesce(1), name)]}})
        return name

    def resume(self, name: str) -> DataFrame:
        """(position, line) of a context given out before. A malformed id is a ValueError, an unknown one a KeyError."""
        if not re.fullmatch("ctx_[0-9a-z]{8}", name):
            raise ValueError(f"no context id: {name!r}")
        manifest = self.versions.current()[1]
        if name not in manifest["tables"]:
            raise KeyError(f"no such context: {name}")
        return self.versions.read(manifest, name, "position long, line string")


def parsed(ref: Column) -> tuple[Column, Column]:
    """Name and hash of name@hash, split at the last separator; null where either is empty."""
    whole = F.regexp_extract(ref, rf"^(.+){SEPARATOR}([^{SEPARATOR}]+)$", 0) != ""
    part = lambda k: F.when(whole, F.regexp_extract(ref, rf"(?s)^(.+){SEPARATOR}([^{SEPARATOR}]+)$", k))
    return part(1), part(2)


def annotated(lines: DataFrame, hashes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(position, line) with each line's leading id as id@hash where the note (id, body_hash) is known, and a line for each anchor (path, content_hash) after them."""
    first = F.split("line", r"\|", 2)
    plain = ~F.startswith("line", F.lit(ANCHOR_LINE)) & ~F.contains(first[0], F.lit(SEPARATOR))
    rows = lines.withColumn("id", F.when(plain, first[0])).join(hashes.select("id", "body_hash"), "id", "left")
    rest = F.when(F.size(first) > 1, F.concat(F.lit("|"), first[1])).otherwise("")
    rows = rows.select("position", F.when(F.col("body_hash").isNotNull(), F.concat("id", F.lit(SEPARATOR), "body_hash", rest)).otherwise(F.col("line")).alias("line"))
    last = lines.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("_last"))
    listed = anchors.agg(F.array_sort(F.collect_set(F.struct("path", "content_hash"))).alias("x")).select(F.posexplode("x").alias("k", "x"))  # a report's own anchors
    return rows.union(listed.join(F.broadcast(last), F.lit(True)).select((F.col("_last") + 1 + F.col("k")).alias("position"), F.concat(F.lit(ANCHOR_LINE), "x.path", F.lit(SEPARATOR), "x.content_hash")))


def verified(lines: DataFrame, notes: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(position, kind, status, name, hash, detail) of the references in lines that don't hold any more.

    notes (id, status, superseded_by, body_hash); records (path) are the anchors known to the index, files (path, content_hash) those there are.
    """
    anchor = F.startswith("line", F.lit(ANCHOR_LINE))
    raw = F.when(anchor, F.substring("line", len(ANCHOR_LINE) + 1, 1 << 20)).otherwise(F.split("line", r"\|", 2)[0])
    name, old = parsed(raw)
    refs = lines.select("position", anchor.alias("_a"), name.alias("name"), old.alias("hash")).where("name is not null")
    own = refs.where("not _a").join(notes.select(F.col("id").alias("name"), "status", "superseded_by", "body_hash"), "name", "left")
    status = (
        F.when(F.col("status").isNull(), "dangling").when(F.col("status") == "forgotten", "retired").when(F.col("status") == "superseded", "superseded")
        .when(F.coalesce("body_hash", F.lit("")) != F.col("hash"), "changed")
    )
    detail = F.when(status == "superseded", F.col("superseded_by")).when(status == "changed", F.col("body_hash"))
    own = own.select("position", F.lit("note").alias("kind"), status.alias("status"), "name", "hash", detail.alias("detail"))
    known = records.select(F.col("path").alias("name")).distinct().withColumn("_known", F.lit(True))
    there = refs.where("_a").join(known, "name", "left").join(files.select(F.col("path").alias("name"), "content_hash"), "name", "left")
    gone = F.col("_known").isNull() | F.col("content_hash").isNull()
    status = F.when(gone, "dangling").when(F.col("content_hash") != F.col("hash"), "changed")
    there = there.select("position", F.lit("anchor").alias("kind"), status.alias("status"), "name", "hash", F.when(status == "changed", F.col("content_hash")).alias("detail"))
    return own.union(there).where("status is not null")


def anchor_records(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, content_hash, role) of literal anchors whose file is there; cited where the body names the path or the file."""
    rows = notes.select("id", "body", F.explode("anchors").alias("path")).where(~has_glob(F.col("path")))
    base = F.element_at(F.split("path", "/"), -1)
    cited = F.contains("body", F.col("path")) | ((base != "") & F.contains(F.col("body"), base))
    return rows.join(files.select("path", "content_hash"), "path").select("id", "path", "content_hash", F.when(cited, "cited").otherwise("context").alias("role")).distinct()


def stale_anchors(records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, role, reason, invalidates) of recorded anchors whose file is missing or has other contents; a cited one invalidates its note."""
    rows = records.join(files.select("path", F.col("content_hash").alias("_now")), "path", "left")
    reason = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("content_hash"), "content_changed")
    return rows.select("id", "path", "role", reason.alias("reason"), (F.col("role") == "cited").alias("invalidates")).where("reason is not null")


def broken_anchors(corpus: Corpus) -> DataFrame:
    """(id, anchor): literal anchors without a file."""
    own = anchors_of(corpus.notes).where(~has_glob(F.col("anchor")))
    return own.join(corpus.paths.select(F.col("path").alias("anchor")).distinct(), "anchor", "left_anti").select("id", "anchor")


def audit(corpus: Corpus, suggested: DataFrame, locks: DataFrame, lock_stale_ms: int) -> DataFrame:
    """(finding, n) of the seven families; suggested (src, dst) are edges someone proposed, locks (path, taken_ms) those on disk."""
    live = corpus.notes.where(F.col("scope").isNull())
    stale = locks.where(F.lit(corpus.now_ms) - F.col("taken_ms") >= lock_stale_ms)
    rings = lambda kind: cyclic(of_kind(corpus.edges, kind)).select("component").distinct()
    parts = {
        "integrity": integrity(corpus), "supersession_cycles": rings("replaces"), "dependency_cycles": rings("depends_on"), "broken_anchors": broken_anchors(corpus),
        "duplicates": merge_proposals(live), "missing_edges": missing_edges(corpus.edges, suggested), "stale_locks": stale,
    }
    count = lambda name, df: df.agg(F.lit(name).alias("finding"), F.count("*").alias("n"))
    out = None
    for name, df in parts.items():
        out = count(name, df) if out is None else out.union(count(name, df))
    return out
