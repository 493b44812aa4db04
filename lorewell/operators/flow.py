"""Task flow, hand-off, clusters and health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.globs import matches, to_regex
from lorewell.functions.scores import age_days, age_factor, confidence
from lorewell.functions.text import content_terms, one_line, token_estimate
from lorewell.operators.confidence import task_confirmation
from lorewell.operators.filters import actionable, glob_pairs
from lorewell.operators.graph import closure, epic_of, impact, integrity, of_kind, views

MIN_TAIL = 100


def task_flows(events: DataFrame) -> DataFrame:
    """(id, created_ms, closed_ms): first event of each note, and its last review."""
    review = F.when((F.col("op") == "task") & (F.col("action") == "review"), F.col("at"))
    return events.where("note_id is not null").groupBy(F.col("note_id").alias("id")).agg(F.min("at").alias("created_ms"), F.max(review).alias("closed_ms"))


def flow_summary(events: DataFrame, now_ms: int) -> DataFrame:
    """One row: notes, closed, and mean cycle and lead times as whole milliseconds."""
    f = task_flows(events)
    lead = F.coalesce("closed_ms", F.lit(now_ms)) - F.col("created_ms")
    return f.agg(F.count("*").alias("notes"), F.count("closed_ms").alias("closed"), F.expr("coalesce(sum(closed_ms - created_ms) DIV nullif(count(closed_ms), 0), 0)").alias("mean_cycle_ms"), F.floor(F.sum(lead) / F.count("*")).alias("mean_lead_ms"))


def throughput(events: DataFrame, window_ms: int) -> DataFrame:
    """(start_ms, closed) by tumbling windows of review events."""
    done = events.where("op = 'task' and action = 'review'")
    return done.groupBy((F.floor(F.col("at") / window_ms) * window_ms).alias("start_ms")).agg(F.count("*").alias("closed"))


def manifest(corpus: Corpus) -> DataFrame:
    """(id, tier, score, created_ms): trust by class, outcomes and confirming tasks."""
    c = task_confirmation(corpus.notes, corpus.settings.confirmation)
    rows = corpus.notes.join(c, "id", "left")
    confirmed, star = F.coalesce(F.col("task") > 0, F.lit(False)), F.col("successes") > 0
    weight = F.when(F.col("classification") == "foundational", 50.0).when(F.col("classification") == "tactical", 20.0).otherwise(10.0)
    score = F.when(star, 100.0).otherwise(0.0) + weight + F.when(confirmed, 100.0).otherwise(0.0)
    return rows.select("id", F.when(confirmed | star, "star").otherwise(F.col("classification")).alias("tier"), score.alias("score"), "created_ms", "statement")


def manifest_rank(corpus: Corpus, limit: int) -> DataFrame:
    return manifest(corpus).orderBy(F.desc("score"), F.desc("created_ms"), "id").limit(limit)


def next_tasks(corpus: Corpus, limit: int | None = None, budget: int | None = None) -> DataFrame:
    """Ready and actionable items, those that most open items wait for first; a token budget allows one for each 200, one to five."""
    if limit is None:
        limit = max(1, min(5, (corpus.settings.budget if budget is None else budget) // 200))
    ready = views(corpus).where("state = 'ready'").select("id")
    rows = corpus.notes.where(actionable()).join(ready, "id", "left_semi").join(impact(corpus), "id", "left")
    rows = rows.select("id", one_line("statement").alias("statement"), F.coalesce("impact", F.lit(0)).cast("long").alias("impact"), "created_ms")
    return rows.orderBy(F.desc("impact"), "created_ms", "id").limit(limit)


def budget_cut(lines: DataFrame, budget: int) -> DataFrame:
    """(position, line) of lines (position, line) within a token budget; the first that overflows is cut if enough is left.

    Lines are a report's own, already limited; the running sum is over them.
    """
    order = W.orderBy("position")
    rows = lines.withColumn("_cost", token_estimate("line"))
    rows = rows.withColumn("_sum", F.sum("_cost").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_over", F.sum((F.col("_sum") > budget).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("_sum") - F.col("_cost"))
    cut = F.concat(F.substring(F.col("line"), F.lit(1), (left * 4).cast("int")), F.lit("…"))
    rows = rows.where((F.col("_over") == 0) | ((F.col("_over") == 1) & (F.col("_sum") > budget) & (left >= MIN_TAIL)))
    return rows.select("position", F.when(F.col("_over") == 0, F.col("line")).otherwise(cut).alias("line"))


def scope_counts(corpus: Corpus, paths: list[str]) -> DataFrame:
    """(epic, hits): anchors of an epic's members that match the changed paths."""
    notes = corpus.notes
    epics = notes.where("scope = 'epic'").select(F.col("id").alias("src"))
    down = closure(of_kind(corpus.edges, "results_in"), epics).toDF("epic", "id")
    flipped = of_kind(corpus.edges, "depends_on").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = closure(flipped, epics).toDF("epic", "id")
    members = down.union(up).union(epics.select("src", F.col("src").alias("_i"))).distinct()
    any_path = F.lit(False)
    for p in paths:
        any_path = any_path | matches(F.col("anchor"), F.lit(p))
    hits = notes.select("id", F.explode("anchors").alias("anchor")).where(any_path)
    return members.join(hits, "id").groupBy("epic").agg(F.count("*").alias("hits"))


def clusters(corpus: Corpus) -> DataFrame:
    """(axis, key, n_members, first_id) on four axes: anchor, type, class, scope."""
    notes = corpus.notes
    kind = F.coalesce("type", F.lit("epic"))
    by = notes.select("id", F.array(F.struct(F.lit("type").alias("axis"), kind.alias("key")), F.struct(F.lit("class").alias("axis"), F.col("classification").alias("key"))).alias("x")).select("id", F.explode("x").alias("x")).select("id", "x.axis", "x.key")
    anchors = notes.select("id", F.lit("anchor").alias("axis"), F.explode("anchors").alias("key"))
    scopes = epic_of(corpus, 8).select("id", F.lit("scope").alias("axis"), F.col("epic").alias("key"))
    rows = by.union(anchors).union(scopes)
    return rows.groupBy("axis", "key").agg(F.countDistinct("id").alias("n_members"), F.min("id").alias("first_id"))


def top_terms(notes: DataFrame, k: int = 8) -> DataFrame:
    """(term, n_notes): the content terms in most statements."""
    rows = notes.select(F.explode(content_terms("statement")).alias("term")).groupBy("term").agg(F.count("*").alias("n_notes"))
    return rows.orderBy(F.desc("n_notes"), "term").limit(k)


def promotions(corpus: Corpus, least: float | None = None) -> DataFrame:
    """(id, confidence): foundational decisions and metas without contradiction whose breadth makes them sure enough."""
    least = corpus.settings.promote_confidence if least is None else least
    rows = corpus.notes.where(F.col("type").isin("meta", "decision") & (F.col("classification") == "foundational"))
    rows = rows.join(of_kind(corpus.edges, "contradicts").select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    breadth = F.least(F.size("anchors") + F.size("tags"), F.lit(5)) / 5.0
    zero = F.lit(0.0)
    sure = F.round(confidence(breadth, age_factor(age_days(F.col("created_ms"), corpus.now_ms)), zero, zero, zero, zero), 6)
    return rows.select("id", sure.alias("confidence")).where(F.col("confidence") >= least)


def outcome(results: DataFrame) -> DataFrame:
    """(note_id, outcome) of check results (note_id, passed, severity): no result abandons, all passed succeed, a failed error fails."""
    g = results.groupBy("note_id").agg(F.count("passed").alias("_n"), F.bool_and("passed").alias("_all"), F.coalesce(F.bool_or(~F.col("passed") & (F.col("severity") == "error")), F.lit(False)).alias("_bad"))
    return g.select("note_id", F.when(F.col("_n") == 0, "abandoned").when(F.col("_all"), "success").when(F.col("_bad"), "failure").otherwise("partial").alias("outcome"))


def resolved_checks(explicit: DataFrame, catalog: DataFrame, anchors: DataFrame) -> DataFrame:
    """(name, source): explicit before global before anchor checks; an explicit name that the catalogue lacks is ``missing``.

    catalog (name, scope): a null scope is global, others glob anchors.
    """
    asked = explicit.select("name").distinct().join(catalog.select("name").distinct().withColumn("_k", F.lit(True)), "name", "left")
    ranked = asked.select("name", F.when(F.col("_k"), 0).otherwise(3).alias("_p")).union(catalog.where("scope is null").select("name", F.lit(1)))
    scoped = catalog.where("scope is not null")
    hit = glob_pairs(scoped.select(F.col("scope").alias("pattern")).distinct(), anchors.select(F.col("anchor").alias("path")).distinct()).select(F.col("pattern").alias("scope")).distinct()
    by_anchor = scoped.join(hit, "scope", "left_semi").select("name", F.lit(2))
    first = ranked.union(by_anchor).groupBy("name").agg(F.min("_p").alias("_p"))
    return first.select("name", F.element_at(F.array(*map(F.lit, ("explicit", "global", "anchor", "missing"))), F.col("_p") + 1).alias("source"))


def accepted(gates: DataFrame, least: float) -> DataFrame:
    """Gates (name, passed, before, after) that passed and gained enough."""
    return gates.where(F.col("passed") & (F.col("after") - F.col("before") >= least))


def doctor(corpus: Corpus) -> DataFrame:
    """(check, findings): one row per family of findings."""
    from lorewell.functions.text import missing_slots
    from lorewell.operators.confidence import losers
    from lorewell.operators.graph import claim_conflicts, cyclic
    from lorewell.operators.lifecycle import anchor_validity, expired

    notes = corpus.notes
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("findings"))
    degree = corpus.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_e"))
    bare = notes.join(degree, "id", "left")
    slots = missing_slots(F.col("type"), F.col("body"), F.size("anchors"), F.coalesce("_e", F.lit(0)))
    return (
        count("integrity", integrity(corpus)).union(count("dependency_cycles", cyclic(of_kind(corpus.edges, "depends_on")))).union(count("broken_anchors", anchor_validity(notes, corpus.paths).where("valid < total")))
        .union(count("expired", expired(corpus))).union(count("contradictions", losers(corpus))).union(count("claim_conflicts", claim_conflicts(notes)))
        .union(count("missing_slots", bare.where(F.coalesce(F.size(slots), F.lit(0)) > 0))).union(count("empty_body", notes.where("trim(body) = ''"))).union(count("long_statement", notes.where("length(statement) > 120")))
    )


def recap(notes: DataFrame, last: int = 30) -> DataFrame:
    """(agent_id, newest_ms, n_notes, decision, error): the latest notes of each agent."""
    order = W.partitionBy("agent_id").orderBy(F.desc("created_ms"), F.desc("id"))
    rows = notes.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= last)
    newest = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("id")), F.when(F.col("type") == kind, F.col("created_ms")))
    return rows.groupBy("agent_id").agg(F.max("created_ms").alias("newest_ms"), F.count("*").alias("n_notes"), newest("decision").alias("decision"), newest("error").alias("error"))


def denied_anchors(notes: DataFrame) -> DataFrame:
    from lorewell.functions.globs import denied

    return notes.select("id", F.explode("anchors").alias("anchor")).where(denied(F.col("anchor")))


def path_matches(paths: DataFrame, pattern: str) -> DataFrame:
    return paths.where(F.rlike("path", F.lit(to_regex(pattern))))
