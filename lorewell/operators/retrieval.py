"""Ranking: postings, BM25F, anchor, semantic and authority channels, fusion, recall and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.globs import either_matches, regex_column
from lorewell.functions.runtime import numbered, written
from lorewell.functions.scores import age_days, age_factor, confidence, idf, posterior_mean, type_weight, wilson
from lorewell.functions.text import one_line, query_terms, tokens, with_stem
from lorewell.functions.vectors import dot, norm
from lorewell.operators.filters import Filter, knowledge
from lorewell.operators.words import rows_with

FIELD_WEIGHT = {"statement": 3.0, "body": 1.0, "tags": 2.0}
K1, B = 1.5, 0.75
HIGH_FREQUENCY_LEAST = 64
RECENT_MS = 7 * 86_400_000
AUTHORITY = ("references", "supports", "extends", "replaces")


def field_tokens(notes: DataFrame, fields: tuple[str, ...] = tuple(FIELD_WEIGHT), once: bool = False) -> DataFrame:
    """(id, field, term) of every stemmed token; with ``once`` a field's equal tokens are one before they are stemmed."""
    words = lambda f: tokens(F.array_join("tags", " ") if f == "tags" else f)
    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.array_distinct(words(f)) if once else words(f)).alias("t")) for f in fields])
    rows = notes.select("id", F.explode(each).alias("f")).select("id", "f.field", F.explode("f.t").alias("tok"))
    return with_stem(rows, "tok", "term").select("id", "field", "term")


def cut_words(notes: DataFrame, *more: Column | str) -> DataFrame:
    """(id, each field's tokens with a space between two, and ``more``): text is folded and cut once, for all that reads it later."""
    return notes.select("id", *[F.array_join(tokens(F.array_join("tags", " ") if f == "tags" else f), " ").alias(f) for f in FIELD_WEIGHT], *more)


def apart(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes whose id no other row has, which can be counted row by row, and the others."""
    twice = written(notes.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id"))
    return notes.join(twice, "id", "left_anti"), notes.join(twice, "id", "left_semi")


def postings(notes: DataFrame) -> DataFrame:
    return field_tokens(notes).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def lengths(notes: DataFrame) -> DataFrame:
    """(id, field, len), empty fields included."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.array_join("tags", " ") if f == "tags" else f)).cast("long").alias("len")) for f in FIELD_WEIGHT])
    return notes.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.len")


def stats(notes: DataFrame) -> DataFrame:
    """One row: the number of notes, and each field's mean length; always of the whole corpus."""
    size = lambda f: F.size(tokens(F.array_join("tags", " ") if f == "tags" else f))
    return notes.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(size(f)), F.lit(0.0)).alias(f"avg_{f}") for f in FIELD_WEIGHT])


def stem_frequency(stems: DataFrame) -> DataFrame:
    """``document_frequency`` of notes as ``cut_stems`` writes them."""
    one, more = apart(stems)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.split(f, " ").alias("t")) for f in FIELD_WEIGHT])).alias("f")
    twice = more.select("id", each).select("id", "f.field", F.explode("f.t").alias("term")).where("term <> ''").distinct()
    rows = rows_with(one, tuple(FIELD_WEIGHT), True).union(twice.select("field", "term", F.lit(1).cast("long")))
    return rows.groupBy("field", "term").agg(F.sum("n").alias("df"))


def document_frequency(notes: DataFrame) -> DataFrame:
    """(field, term, df); rows with one id are one note."""
    one, more = apart(notes)
    rows = rows_with(cut_words(one), tuple(FIELD_WEIGHT)).union(field_tokens(more, once=True).distinct().select("field", "term", F.lit(1).cast("long")))
    return rows.groupBy("field", "term").agg(F.sum("n").alias("df"))


def term_table(notes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, field, len, tf) of every field with words: its length, and how often each of a query's terms is in it.

    One scan of the text; written, as a query's statistics and scores both come from it.
    """
    count = F.array(*[F.count_if(F.col("term") == t) for t in terms]).cast("array<bigint>")
    return written(field_tokens(notes).groupBy("id", "field").agg(F.count("*").alias("len"), count.alias("tf")))


def _frequencies(table: DataFrame, terms: list[str], n: int, words: dict[str, int], max_ratio: float) -> tuple[list[int], dict[str, tuple[float, list[int]]]]:
    """Places of the kept terms, and of each field with ``words`` the mean length and document frequencies: a few numbers."""
    per = [F.count_if(F.col("tf")[k] > 0) for k in range(len(terms))]
    rows = {r.field: list(r.df) for r in table.groupBy("field").agg(F.array(*per).cast("array<bigint>").alias("df")).collect()}
    fields = {f: (total / n, rows.get(f, [0] * len(terms))) for f, total in words.items()}
    most = [max((df[k] for _, df in fields.values()), default=0) for k in range(len(terms))]
    kept = [k for k in range(len(terms)) if not (max_ratio > 0 and n >= HIGH_FREQUENCY_LEAST and most[k] / n >= max_ratio)]
    return kept, fields


def _words(table: DataFrame) -> dict[str, int]:
    return {r.field: r.total for r in table.groupBy("field").agg(F.sum("len").alias("total")).collect()}


def kept_terms(notes: DataFrame, query: str, max_ratio: float) -> list[str]:
    """A query's terms that occur and are not cut as too frequent."""
    terms = sorted(set(query_terms(query)))
    if not terms:
        return []
    table = term_table(notes, terms)
    kept, fields = _frequencies(table, terms, notes.count(), _words(table), max_ratio)
    return [terms[k] for k in kept if any(df[k] for _, df in fields.values())]


def bm25(notes: DataFrame, query: str, max_ratio: float = 0.9) -> DataFrame:
    """(id, raw, body_raw, score) of the notes that a query's terms hit; statistics are those of all ``notes``."""
    wanted = query_terms(query)
    terms = sorted(set(wanted))
    if not terms:
        return notes.sparkSession.createDataFrame([], "id string, raw double, body_raw double, score double")
    table = term_table(notes, terms)
    return scored(notes, table, wanted, notes.count(), _words(table), max_ratio)


def scored(notes: DataFrame, table: DataFrame, wanted: list[str], n: int, words: dict[str, int], max_ratio: float) -> DataFrame:
    """(id, raw, body_raw, score) of a table (id, field, len, tf by sorted distinct term), where n notes have ``words`` in each field in all."""
    terms = sorted(set(wanted))
    kept, fields = _frequencies(table, terms, n, words, max_ratio)
    part = F.lit(0.0)
    for field, (mean, df) in fields.items():
        norm = (F.lit(1.0) - B) + F.col("len") * B / F.lit(mean) if mean > 0 else F.lit(1.0)
        own = F.lit(0.0)
        for k in kept:
            if df[k]:
                tf = F.col("tf")[k]
                own = own + F.lit(FIELD_WEIGHT[field]) * idf(F.lit(n), F.lit(df[k])) * tf * (K1 + 1) / (tf + norm * K1) * wanted.count(terms[k])
        part = part + F.when(F.col("field") == field, own).otherwise(0.0)
    hit = F.lit(False)
    for k in kept:
        hit = hit | (F.col("tf")[k] > 0)
    rows = table.where(hit).withColumn("part", part)
    sums = rows.groupBy("id").agg(F.sum("part").alias("raw"), F.sum(F.when(F.col("field") == "body", F.col("part")).otherwise(0.0)).alias("body_raw"))
    kind = notes.select("id", type_weight(F.coalesce("type", F.lit("epic"))).alias("_w"), "successes")
    return sums.join(kind, "id").select("id", "raw", "body_raw", (F.col("raw") * F.col("_w") * (F.col("successes") * 0.1 + 1.0)).alias("score"))


def top(rows: DataFrame, score: str, k: int, digits: int = 6) -> DataFrame:
    """The k best by rounded score, then id; all where k is 0."""
    rows = rows.withColumn(score, F.round(score, digits))
    ranked = rows.orderBy(F.desc(score), "id")
    return ranked.limit(k) if k else ranked


def ranked(rows: DataFrame, score: str, channel: str, k: int = 0) -> DataFrame:
    """(id, channel, rank from 0) by rounded score and id; ``k`` first of them. Whole channels are ranked by ranges, not in one task."""
    rows = rows.withColumn(score, F.round(score, 6)).select("id", score)
    order = [F.desc(score), F.col("id")]
    if k:
        few = rows.orderBy(*order).limit(k)
        return few.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1).select("id", F.lit(channel).alias("channel"), "rank")
    return numbered(rows, *order).select("id", F.lit(channel).alias("channel"), F.col("position").cast("int").alias("rank"))


def anchor_hits(notes: DataFrame, paths: list[str], ids: list[str] = ()) -> DataFrame:
    """(id, hits, file, own): anchors that match working paths, and working ids that equal or match an anchor. The working set is a short list."""
    count = lambda test, values: sum((F.when(test(v), 1).otherwise(0) for v in values), F.lit(0))
    a = F.col("anchor")
    rows = notes.select("id", F.explode("anchors").alias("anchor"))
    files = count(lambda p: either_matches(a, F.lit(p)) if any(c in p for c in "*?") else F.rlike(F.lit(p), regex_column(a)), paths)
    own = count(lambda i: (F.col("id") == i) | F.rlike(F.lit(i), regex_column(a)), ids)
    rows = rows.withColumn("_f", files).withColumn("_i", own)
    return rows.groupBy("id").agg((F.sum("_f") + F.sum("_i")).cast("long").alias("hits"), (F.sum("_f") > 0).alias("file"), (F.sum("_i") > 0).alias("own")).where("hits > 0")


def similar_to(vectors: DataFrame, query: list[float], least: float, k: int) -> DataFrame:
    """(id, similarity) of the k vectors most similar to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    n = norm(F.col("vector")) * length
    sim = F.when(n > 0, dot(F.col("vector"), q) / n).otherwise(0.0)
    return top(vectors.select("id", sim.alias("similarity")).where(F.round("similarity", 6) >= least), "similarity", k)


def fuse(channels: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (id, channel, rank): score, and what each channel adds."""
    weight = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(w))])
    part = weight[F.col("channel")] / (F.col("rank") + k + 1)
    parts = [F.sum(F.when(F.col("channel") == c, part).otherwise(0.0)).alias(c) for c in weights]
    return channels.groupBy("id").agg(F.sum(part).alias("score"), *parts)


def recall(
    corpus: Corpus, query: str, paths: list[str], vector: list[float] | None, f: Filter = Filter(), limit: int | None = None, ids: tuple[str, ...] = (), scope: str | None = None, as_of: int | None = None,
) -> DataFrame:
    """Hybrid recall: candidates, up to four channels, fusion, confidence and the reason for each hit.

    Candidates pass the filter and are shown by default; with ``scope`` they depend on that note, directly or not, or are it; with
    ``as_of`` they were active then by the log, whatever has become of them since (unless the filter asks for a present status). ``ids`` are working ids beside working paths. The authority channel is on where its weight is above 0.
    """
    from lorewell.operators.confidence import losers, task_confirmation
    from lorewell.operators.graph import downstream, of_kind, pagerank
    from lorewell.operators.lifecycle import active_as_of

    s = corpus.settings
    limit = s.limit if limit is None else limit
    notes = corpus.notes
    allowed = notes.where((f.shown() if as_of is None else f.column()) & knowledge())
    if as_of is not None:
        allowed = allowed.join(active_as_of(corpus, as_of), "id", "left_semi")
    inside = notes.select("id").limit(0)
    if scope is not None:
        start = notes.sparkSession.createDataFrame([(scope,)], "id string")
        inside = written(start.union(downstream(of_kind(corpus.edges, "depends_on"), start)).distinct())
        allowed = allowed.join(inside, "id", "left_semi")
    confirmed = written(task_confirmation(notes, s.confirmation))
    boost = bm25(notes, query, s.max_term_ratio).join(confirmed, "id", "left").withColumn("score", F.col("score") * (F.greatest(F.coalesce("task", F.lit(0.0)), F.lit(0.0)) + 1.0))
    keep = allowed.select("id")
    lexical = ranked(boost.where("score > 0").join(keep, "id", "left_semi"), "score", "lexical")
    hits = written(anchor_hits(allowed, paths, list(ids)))
    channels = lexical.union(ranked(hits, "hits", "anchor"))
    if vector is not None and corpus.vectors is not None:
        near = similar_to(corpus.vectors, vector, 0.0, s.semantic_top_k).join(keep, "id", "left_semi")
        channels = channels.union(ranked(near, "similarity", "semantic", s.semantic_top_k))
    if s.ppr > 0:
        ranks = pagerank(notes.select("id"), of_kind(corpus.edges, *AUTHORITY), hits.select("id")).join(keep, "id", "left_semi")
        channels = channels.union(ranked(ranks.withColumn("rank", F.col("rank") * 1000), "rank", "ppr"))
    fused = top(fuse(channels, {"lexical": s.lexical, "anchor": s.anchor, "semantic": s.semantic, "ppr": s.ppr}, s.rrf_k), "score", limit, 9)
    # at most ``limit`` rows from here on
    best = fused.agg(F.max("score").alias("_best"))
    out = fused.join(F.broadcast(best), F.lit(True)).join(notes, "id").join(confirmed, "id", "left").join(losers(corpus, confirmed=confirmed).withColumn("_lost", F.lit(True)), "id", "left").join(hits.select("id", "file", "own"), "id", "left")
    out = out.join(inside.withColumn("_inside", F.lit(True)), "id", "left")
    days = age_days(F.col("created_ms"), corpus.now_ms)
    task = F.coalesce("task", F.lit(0.0))
    similarity = F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(0.0)
    sure = confidence(similarity, age_factor(days), wilson(F.col("successes"), F.col("failures")), F.lit(0.0), task, F.lit(0.0))
    sure = F.when(F.col("_lost"), F.greatest(sure - 0.1, F.lit(0.0))).otherwise(sure)
    why = (
        F.when(F.col("file"), "file_match").when(F.col("own"), "anchor_match").when(F.col("_inside"), "tracker_match").when((F.col("successes") > 0) | (task > 0), "stars").when(F.col("semantic") > 0, "semantic")
        .when(F.lit(corpus.now_ms) - F.col("created_ms") <= RECENT_MS, "recent").otherwise("universal")
    )
    stars = F.least(posterior_mean(F.col("successes"), F.col("failures")) + task, F.lit(1.0))
    return out.select("id", "statement", "score", F.round(sure, 6).alias("confidence"), why.alias("why"), F.round("lexical", 9).alias("lexical"), F.round("anchor", 9).alias("anchor"), F.round("semantic", 9).alias("semantic"), F.round(age_factor(days), 6).alias("recent"), F.round(stars, 6).alias("stars"))


def tag_counts(notes: DataFrame) -> DataFrame:
    live = notes.where(~F.col("status").isin("superseded", "forgotten"))
    return live.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_notes"))


def formatted(hits: DataFrame) -> DataFrame:
    """Pipe text of hits: id|statement|score|why."""
    return hits.select(F.concat_ws("|", "id", one_line("statement"), F.format_string("%.2f", "score"), "why").alias("line"))


def retrieval_measures(ranking: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query, recall, mrr, ndcg) at k of ranking (query, id, rank from 0) against relevant (query, id)."""
    first = ranking.where(F.col("rank") < k).join(relevant, ["query", "id"])
    gain = first.groupBy("query").agg(F.count("*").alias("_hits"), F.min("rank").alias("_first"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 2.0)).alias("_dcg"))
    many = relevant.groupBy("query").agg(F.count("*").alias("_rel"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least("_rel", F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 2.0))
    out = many.join(gain, "query", "left")
    zero = F.lit(0.0)
    return out.select("query", F.coalesce(F.col("_hits") / F.col("_rel"), zero).alias("recall"), F.coalesce(F.lit(1.0) / (F.col("_first") + 1), zero).alias("mrr"), F.coalesce(F.col("_dcg") / ideal, zero).alias("ndcg"))
