"""Expiry, retention, drift, demotion, temporal views, usage and the event diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus, Settings
from lorewell.functions.runtime import written
from lorewell.functions.scores import DAY_MS, age_days, age_factor, confidence, retention, ttl_days, wilson
from lorewell.functions.text import content_terms
from lorewell.operators.confidence import losers
from lorewell.operators.filters import anchors_of, glob_pairs
from lorewell.operators.graph import cyclic, defeated, of_kind

EXPIRING_DAYS = 7
DRIFT_NOTES, DRIFT_LEAST, SMOOTHING = 4, 0.5, 1e-9


def expiry(s: Settings, last_seen: Column | None = None) -> Column:
    """When a note expires, in ms; null for never. Outcomes renew it, and uses where settings say so."""
    origin = F.greatest("created_ms", F.coalesce("last_ms", F.col("created_ms")))
    if s.renew_on_use and last_seen is not None:
        origin = F.greatest(origin, F.coalesce(last_seen, F.lit(0)))
    return origin + ttl_days(F.col("classification"), F.col("reviews"), s.ttl, s.growth_percent) * DAY_MS


def expired(corpus: Corpus) -> DataFrame:
    return corpus.notes.where(expiry(corpus.settings) <= corpus.now_ms).select("id", expiry(corpus.settings).alias("expiry_ms"))


def freshness(corpus: Corpus) -> DataFrame:
    e, now = expiry(corpus.settings), corpus.now_ms
    return corpus.notes.agg(F.count_if(e <= now).alias("stale"), F.count_if((e > now) & (e - now <= EXPIRING_DAYS * DAY_MS)).alias("expiring"), F.count("*").alias("notes"))


def retained(corpus: Corpus) -> DataFrame:
    """(id, retention): what is left of each note now."""
    s = corpus.settings
    origin = F.greatest("created_ms", F.coalesce("last_ms", F.col("created_ms")))
    days = F.greatest(F.floor((F.lit(corpus.now_ms) - origin) / DAY_MS), F.lit(0)).cast("double")
    return corpus.notes.select("id", retention(days, ttl_days(F.col("classification"), F.col("reviews"), s.ttl, s.growth_percent)).alias("retention"))


def anchor_validity(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, total, valid, drift): a glob is valid if any path matches it, a literal anchor if its file exists."""
    own = anchors_of(notes)
    known = glob_pairs(own.select(F.col("anchor").alias("pattern")).distinct(), paths.select("path").distinct()).select(F.col("pattern").alias("anchor")).distinct()
    rows = own.join(known.withColumn("_ok", F.lit(1)), "anchor", "left")
    out = rows.groupBy("id").agg(F.count("*").alias("total"), F.count("_ok").alias("valid"))
    return out.withColumn("drift", F.lit(1.0) - F.col("valid") / F.col("total"))


def _js(old: Column, new: Column, both: Column) -> Column:
    half = lambda p: F.when(p > 0, p * F.log2(p / both)).otherwise(0.0)
    return (half(old) + half(new)) / 2


def topic_drift(notes: DataFrame) -> DataFrame:
    """(anchor, n_notes, js): Jensen-Shannon divergence between the older and the newer half of an anchor's notes."""
    own = notes.select("id", "created_ms", F.explode("anchors").alias("anchor"), F.concat_ws("\n", "statement", "body").alias("_t"))
    many = own.groupBy("anchor").agg(F.count("*").alias("n_notes")).where(F.col("n_notes") >= DRIFT_NOTES)
    place = W.partitionBy("anchor").orderBy("created_ms", "id")
    rows = own.join(many, "anchor").withColumn("_old", F.row_number().over(place) <= F.floor(F.col("n_notes") / 2))
    terms = rows.select("anchor", "n_notes", "_old", F.explode(content_terms("_t")).alias("term"))
    count = terms.groupBy("anchor", "n_notes", "term").agg(F.count_if("_old").alias("_a"), F.count_if(~F.col("_old")).alias("_b"))
    whole = count.groupBy("anchor").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    p, q = F.coalesce(F.col("_a") / F.nullif("_na", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("_b") / F.nullif("_nb", F.lit(0)), F.lit(0.0))
    return count.join(whole, "anchor").groupBy("anchor", "n_notes").agg(F.sum(_js(p, q, (p + q) / 2)).alias("js"))


def drifted(notes: DataFrame) -> DataFrame:
    hot = topic_drift(notes).where(F.round("js", 9) >= DRIFT_LEAST).select("anchor")
    return anchors_of(notes).join(hot, "anchor", "left_semi").select("id").distinct()


def demotion_plan(corpus: Corpus) -> DataFrame:
    """(id, reason, action): the first reason that applies; members of cycles are left alone.

    Decay of anchors counts only where the listing of paths can be trusted (``covered``).
    """
    s, notes = corpus.settings, corpus.notes
    ring = cyclic(of_kind(corpus.edges, "depends_on")).select("id").union(cyclic(of_kind(corpus.edges, "replaces")).select("id")).distinct()
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    validity = written(anchor_validity(notes, corpus.paths))
    rows = notes.join(ring, "id", "left_anti").join(validity, "id", "left")
    rows = rows.join(flag(losers(corpus, task=False), "_lost"), "id", "left").join(flag(defeated(corpus), "_beaten"), "id", "left").join(flag(drifted(notes), "_drifted"), "id", "left")
    zero = F.lit(0.0)
    days = age_days(F.col("created_ms"), corpus.now_ms)
    sure = confidence(zero, age_factor(days), wilson(F.col("successes"), F.col("failures")), zero, zero, zero)
    decayed = (F.col("classification") != "foundational") & (F.col("total") > 0) & (F.col("valid") / F.col("total") < s.anchor_threshold) & (days >= s.grace_days) & (sure < 0.5)
    reason = F.when(expiry(s) <= corpus.now_ms, "expired").when(decayed, "anchor_decay").when(F.col("_lost"), "contradicted").when(F.col("_beaten"), "defeated").when(F.col("_drifted"), "drifted")
    plan = rows.select("id", reason.alias("reason")).where("reason is not null")
    return covered(plan, validity).withColumn("action", F.when(F.col("reason").isin("expired", "anchor_decay"), "forget").otherwise("review"))


def covered(plan: DataFrame, validity: DataFrame, least: float = 0.5) -> DataFrame:
    """Without anchor_decay where too few of all anchors are valid to trust the listing of paths."""
    share = validity.agg((F.sum("valid") / F.sum("total")).alias("_share"))
    return plan.join(F.broadcast(share), F.lit(True)).where((F.col("reason") != "anchor_decay") | (F.coalesce("_share", F.lit(0.0)) >= least)).drop("_share")


def retirements(corpus: Corpus) -> DataFrame:
    """(id, retired_at, reason, due): the latest forget or supersede of each note, the later in the log at a tie."""
    e = corpus.events.where(F.col("op").isin("forget", "supersede") & F.col("note_id").isNotNull())
    last = e.groupBy(F.col("note_id").alias("id")).agg(F.max(F.struct("at", "event_id", "op")).alias("x"))
    return last.select("id", F.col("x.at").alias("retired_at"), F.col("x.op").alias("reason"), (F.col("x.at") + corpus.settings.retired_days * DAY_MS <= corpus.now_ms).alias("due"))


def merge_usage(existing: DataFrame, cited: DataFrame, now_ms: int) -> DataFrame:
    """(id, hits, last_seen_ms): a cited note gains one hit, once per instant."""
    rows = existing.join(cited.select("id").distinct().withColumn("_c", F.lit(True)), "id", "full_outer")
    again = F.col("_c") & (F.coalesce("last_seen_ms", F.lit(-1)) != now_ms)
    return rows.select("id", (F.coalesce("hits", F.lit(0)) + F.when(again, 1).otherwise(0)).cast("long").alias("hits"), F.when(F.col("_c"), F.greatest(F.coalesce("last_seen_ms", F.lit(0)), F.lit(now_ms))).otherwise(F.col("last_seen_ms")).alias("last_seen_ms"))


def latest_drift(entries: DataFrame) -> DataFrame:
    """(id, drift): the last entry of each note by ``seq``."""
    return entries.groupBy("id").agg(F.max_by("drift", "seq").alias("drift"))


def active_as_of(corpus: Corpus, at: int) -> DataFrame:
    """(id): notes created by then, not superseded by a link and not forgotten, as the log stood."""
    log = corpus.events.where(F.col("at") <= at)
    last = log.where(F.col("op").isin("forget", "restore")).groupBy(F.col("note_id").alias("id")).agg(F.max_by("op", "event_id").alias("op"))
    gone = last.where("op = 'forget'").select("id").union(log.where("op = 'link' and kind = 'replaces'").select(F.col("dst").alias("id")))
    return corpus.notes.where(F.col("created_ms") <= at).select("id").join(gone.where("id is not null").distinct(), "id", "left_anti")


def event_diff(corpus: Corpus, since: int | None, until: int | None, scope: DataFrame | None = None) -> DataFrame:
    """Distinct (at, note_id, op) within the time, and the scope (id) if given."""
    rows = corpus.events
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    if until is not None:
        rows = rows.where(F.col("at") <= until)
    if scope is not None:
        rows = rows.join(scope.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return rows.select("at", "note_id", "op").distinct()
