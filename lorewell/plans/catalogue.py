"""Queries by name over the bound corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import ids, scores, text
from lorewell.operators import communities as communities_of
from lorewell.operators import confidence, dedup, filters, flow, graph, lifecycle, paths, retrieval, semantic

from lorewell.operators.filters import Filter
from lorewell.sources import bound

QUERY = "the erha thtion hation"
PATHS = ["src/src1/doc_1.rs", "src/src5/doc_5.rs", "src/src3/doc_43.rs"]
AS_OF = 1_702_000_000_000
LOG_AS_OF = 1_704_500_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _query_vector(c) -> list[float]:
    row = c.vectors.where("id = 'n0000000000'").select("vector").first()
    return [float(x) for x in row[0]] if row else []


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query
def token_df(s, d):
    return retrieval.document_frequency(bound.notes(s, d))


@query
def bm25_topk(s, d):
    n = bound.notes(s, d)
    return retrieval.top(retrieval.bm25(n, QUERY).select("id", "score"), "score", 20)


@query
def bm25_highfreq_cut(s, d):
    n = bound.notes(s, d)
    return s.createDataFrame([(t,) for t in retrieval.kept_terms(n, QUERY, 0.5)], "term string")


@query
def bm25_body_share(s, d):
    rows = retrieval.bm25(bound.notes(s, d), QUERY)
    return rows.select("id", F.round(F.when(F.col("raw") > 0, F.least(F.greatest(F.col("body_raw") / F.col("raw"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0), 6).alias("share"))


@query
def tag_counts(s, d):
    return retrieval.tag_counts(bound.notes(s, d))


@query
def structural_filter(s, d):
    f = Filter(types=("fact", "decision", "error"), classes=("foundational", "tactical"), tags=("en", "fr"), roles=("main",), anchors=("src/src1*/**",), since=1_700_000_000_000, until=1_735_000_000_000)
    return filters.structural(bound.notes(s, d), f).where(filters.visible()).select("id")


@query
def anchor_channel(s, d):
    return retrieval.anchor_hits(bound.notes(s, d), PATHS, ["n0000000003"]).select("id", "hits", "file")


@query
def semantic_topk(s, d):
    c = bound.corpus(s, d)
    return retrieval.similar_to(c.vectors, _query_vector(c), 0.0, 50)


@query
def rrf_fuse(s, d):
    n = bound.notes(s, d)
    lex = retrieval.ranked(retrieval.bm25(n, QUERY).select("id", "score"), "score", "lexical", 50)
    anc = retrieval.ranked(retrieval.anchor_hits(n, PATHS).select("id", "hits"), "hits", "anchor")
    return retrieval.fuse(lex.union(anc), {"lexical": 1.0, "anchor": 2.0}).select("id", _r("score", 9), _r("lexical", 9), _r("anchor", 9))


@query
def recall_hybrid(s, d):
    c = bound.corpus(s, d)
    return retrieval.recall(c, QUERY, PATHS, _query_vector(c), limit=25)


@query
def rank_confidence(s, d):
    return confidence.rank(bound.corpus(s, d), limit=25)


@query
def wilson_confidence(s, d):
    n = bound.notes(s, d)
    return n.select("id", F.round(scores.posterior_mean(F.col("successes"), F.col("failures")), 6).alias("posterior"), F.round(scores.wilson(F.col("successes"), F.col("failures")), 6).alias("wilson"))


@query
def task_confirmation(s, d):
    return confidence.task_confirmation(bound.notes(s, d)).select("id", _r("task"))


@query
def contradiction_losers(s, d):
    return confidence.losers(bound.corpus(s, d))


@query
def freshness(s, d):
    return lifecycle.freshness(bound.corpus(s, d))


@query
def expired(s, d):
    return lifecycle.expired(bound.corpus(s, d))


@query
def retention(s, d):
    return lifecycle.retained(bound.corpus(s, d)).select("id", _r("retention"))


@query
def anchor_drift(s, d):
    c = bound.corpus(s, d)
    return lifecycle.anchor_validity(c.notes, c.paths).select("id", "total", "valid", _r("drift"))


@query
def topic_drift_js(s, d):
    return lifecycle.topic_drift(bound.notes(s, d)).select("anchor", "n_notes", _r("js"))


@query
def demotion_plan(s, d):
    return lifecycle.demotion_plan(bound.corpus(s, d))


@query
def as_of_active(s, d):
    return lifecycle.active_as_of(bound.corpus(s, d), LOG_AS_OF)


@query
def retirements(s, d):
    return lifecycle.retirements(bound.corpus(s, d))


@query
def usage_merge(s, d):
    c = bound.corpus(s, d)
    had = c.events.where("event_id % 2 = 0").groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("hits"), F.max("at").alias("last_seen_ms"))
    cited = c.events.where("event_id % 5 = 0").select(F.col("note_id").alias("id"))
    return lifecycle.merge_usage(had, cited, c.now_ms)


@query
def event_diff(s, d):
    return lifecycle.event_diff(bound.corpus(s, d), AS_OF, None)


@query
def dice_pairs(s, d):
    return dedup.merge_proposals(bound.notes(s, d).where("scope is null")).select("keep", "drop", _r("score"))


@query
def statement_pairs(s, d):
    return dedup.merge_proposals(bound.notes(s, d).where("scope is not null"), fields=("statement",)).select("keep", "drop", _r("score"))


@query
def dup_proposals_lsh(s, d):
    return dedup.banded_proposals(bound.notes(s, d)).select("keep", "drop", _r("score"))


@query
def compact_strategies(s, d):
    n = bound.notes(s, d)
    return dedup.compact_strategy(dedup.merge_proposals(n.where("scope is null")), n).select("keep", "drop", "strategy")


@query
def write_decisions(s, d):
    n = bound.notes(s, d)
    drafts = n.where("doc_id % 41 = 3").select(F.concat(F.lit("d"), "id").alias("draft_id"), "statement", F.when(F.col("doc_id") % 2 == 0, F.left("body", F.lit(400))).otherwise(F.col("body")).alias("body"), "tags")
    return dedup.write_decisions(n, drafts)


@query
def bfs_expand(s, d):
    return graph.expand(bound.edges(s, d), "n0000000040", 2)


@query
def closure_depends(s, d):
    return graph.closure(graph.of_kind(bound.edges(s, d), "depends_on"))


@query
def cycles(s, d):
    return graph.cyclic(graph.of_kind(bound.edges(s, d), "depends_on", "related"))


@query
def ready_blocked(s, d):
    return graph.views(bound.corpus(s, d))


@query
def integrity(s, d):
    return graph.integrity(bound.corpus(s, d))


@query
def pagerank(s, d):
    c = bound.corpus(s, d)
    ranks = graph.pagerank(c.notes.select("id"), graph.of_kind(c.edges, "references", "supports", "extends", "replaces"))
    return ranks.select("id", F.round(F.col("rank") * 1000, 6).alias("rank_per_mille"))


@query
def same_as_classes(s, d):
    return graph.classes(graph.of_kind(bound.edges(s, d), "same_as"))


@query
def broader_closure(s, d):
    return graph.closure(graph.of_kind(bound.edges(s, d), "broader"))


@query
def claim_conflicts(s, d):
    return graph.claim_conflicts(bound.notes(s, d))


@query
def tms_defeated(s, d):
    return graph.defeated(bound.corpus(s, d))


@query
def impact(s, d):
    return graph.impact(bound.corpus(s, d))


@query
def critical_path(s, d):
    c = bound.corpus(s, d)
    lead = flow.task_flows(c.events).select("id", (F.coalesce("closed_ms", F.lit(c.now_ms)) - F.col("created_ms")).alias("duration"))
    best = graph.critical_path(graph.of_kind(c.edges, "depends_on"), lead.join(c.notes.select("id"), "id", "left_semi"))
    return best.select("id", "total", F.col("n").alias("n_steps"))


@query
def progress(s, d):
    c = bound.corpus(s, d)
    return graph.progress(c, c.notes.where("scope = 'epic'").select("id"))


@query
def epics(s, d):
    return graph.epic_of(bound.corpus(s, d))


@query
def subtree(s, d):
    return graph.subtree(bound.corpus(s, d), "n0000000001")


@query
def history(s, d):
    start = s.createDataFrame([("n0000000057",)], "id string")
    return paths.history(bound.edges(s, d), bound.notes(s, d), start).select("id", "step")


@query
def scope_members(s, d):
    return graph.in_scope(bound.corpus(s, d), "n0000000010")


@query
def structural_clusters(s, d):
    return flow.clusters(bound.corpus(s, d))


@query
def global_terms(s, d):
    return flow.top_terms(bound.notes(s, d))


@query
def knn_per_note(s, d):
    v = bound.vectors(s, d)
    return semantic.neighbours(v, v.where("substr(id, 10) in ('00', '50')"), 5, 0.0)


@query
def similar_pairs(s, d):
    return semantic.similar_pairs(bound.vectors(s, d), 0.45)


@query
def semantic_suggestions(s, d):
    c = bound.corpus(s, d)
    return semantic.suggestions(c, c.vectors.where("substr(id, 10) in ('00', '50')"), 10)


@query
def unlinked(s, d):
    c = bound.corpus(s, d)
    return semantic.unlinked(c.vectors, c.edges)


@query
def complete_link(s, d):
    v = bound.vectors(s, d)
    return semantic.complete_link(v.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster"), "id"), v, 0.8, 10)


@query
def communities(s, d):
    return communities_of.found(bound.corpus(s, d))


@query
def task_flow(s, d):
    return flow.task_flows(bound.events(s, d)).withColumn("closed_ms", F.coalesce("closed_ms", F.lit(-1)))


@query
def flow_summary(s, d):
    return flow.flow_summary(bound.events(s, d), bound.NOW_MS)


@query
def throughput(s, d):
    return flow.throughput(bound.events(s, d), 86_400_000)


@query
def manifest_rank(s, d):
    return flow.manifest_rank(bound.corpus(s, d), 50).select("id", "tier", "score", "created_ms")


@query
def next_tasks(s, d):
    return flow.next_tasks(bound.corpus(s, d), 20)


@query
def budget_cut(s, d):
    top = bound.notes(s, d).orderBy("id").limit(200).select((F.col("doc_id")).alias("position"), F.concat_ws("|", "id", text.one_line("statement")).alias("line"))
    return flow.budget_cut(top, 1500)


@query
def auto_scope(s, d):
    return flow.scope_counts(bound.corpus(s, d), PATHS)


@query
def promotions(s, d):
    return flow.promotions(bound.corpus(s, d), 0.05)


@query
def doctor_checks(s, d):
    return flow.doctor(bound.corpus(s, d))


@query
def agent_recap(s, d):
    return flow.recap(bound.notes(s, d))


@query
def missing_slots(s, d):
    n = bound.notes(s, d)
    degree = bound.edges(s, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("e"))
    slots = text.missing_slots(F.col("type"), F.col("body"), F.size("anchors"), F.coalesce("e", F.lit(0)))
    return n.join(degree, "id", "left").select("id", F.array_join(slots, ",").alias("slots")).where("slots <> ''")


@query
def note_ids(s, d):
    n = bound.notes(s, d)
    return n.where("type is not null").select("id", ids.note_id(F.col("type"), F.col("statement")).alias("note_id"), ids.body_hash(F.col("statement"), F.col("body")).alias("body_hash"), ids.format_utc(F.col("created_ms")).alias("created_at"))


@query
def ndcg_eval(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    ranking = docs.where("lang is not null").selectExpr("lang as query", "doc_id as id", "cast((doc_id * 7919) % 1000 as int) as rank")
    relevant = docs.where("doc_id % 9 = 0 and lang is not null").selectExpr("lang as query", "doc_id as id")
    m = retrieval.retrieval_measures(ranking, relevant, 50)
    return m.select("query", _r("recall"), _r("mrr"), _r("ndcg"))


@query
def shard_merge(s, d):
    from lorewell.sources.logs import latest_per_id

    c = s.read.parquet(f"{d}/conversations.parquet")
    rows = c.selectExpr("concat('c', cast(conv_id as string)) as id", "turn as created_ms", "role as agent_id", "concat(role, '.jsonl') as _origin", "text as statement")
    return latest_per_id(rows).select("id", "created_ms", "agent_id")


@query
def event_log_dedup(s, d):
    from lorewell.sources.logs import first_per_id

    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.selectExpr("concat('evt_', cast(user_id as string), event_type) as id", "'events-0001' as _segment", "event_id as _line", "event_type as op")
    return first_per_id(rows).select("id", "_line")


@query
def write_plan(s, d):
    from lorewell.operators.writes import plan_writes

    n = bound.notes(s, d).withColumn("body_hash", ids.body_hash(F.col("statement"), F.col("body")))
    drafts = n.where("doc_id % 53 = 1 and type is not null").select(F.concat(F.lit("d"), "id").alias("draft_id"), F.when(F.col("type") == "task", "fact").otherwise(F.col("type")).alias("type"), "statement", "body", "tags")
    return plan_writes(n, drafts)


@query
def learn_proposals(s, d):
    from lorewell.operators.writes import learn

    return learn(bound.corpus(s, d), [*PATHS, "src/none/at_all.rs"])


@query
def hub_notes(s, d):
    from lorewell.operators.writes import hub_notes as hubs

    c = bound.notes(s, d).select("id", F.lit("class").alias("axis"), F.col("classification").alias("key"))
    return hubs(c).select("id", "statement", F.size("edges").cast("long").alias("n_members"))
