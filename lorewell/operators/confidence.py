"""Derived confidence, task confirmation, contradictions, and the confidence ranking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.runtime import written
from lorewell.functions.scores import age_days, age_factor, confidence, posterior_mean, wilson
from lorewell.operators.filters import Filter, anchor_pairs, anchors_of, knowledge


def success_tasks(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("scope").isNotNull() & (F.col("successes") > 0))


def task_confirmation(notes: DataFrame, weight: float = 0.1) -> DataFrame:
    """(id, task): ``weight`` for each successful task that shares an anchor, up to 1; notes without any are absent.

    The sum saturates at 1/weight tasks, so no anchor needs to keep more than that many: a hot anchor
    gives a bounded number of rows, and nothing is lost.
    """
    most = math.ceil(1.0 / weight - 1e-9)
    own = anchors_of(notes, "a")
    tasks = anchors_of(success_tasks(notes), "b").withColumnRenamed("id", "task_id")
    few = lambda rows, key: rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("task_id"))).where(F.col("_k") <= most).drop("_k")
    tasks = few(tasks.distinct(), "b")
    pairs = anchor_pairs(own.select("a"), tasks.select("b"))
    by_anchor = few(pairs.join(tasks, "b").select("a", "task_id").distinct(), "a")
    count = own.join(by_anchor, "a").groupBy("id").agg(F.countDistinct("task_id").alias("_n"))
    return count.select("id", F.least(F.col("_n") * weight, F.lit(1.0)).alias("task"))


def base_confidence(corpus: Corpus, drift: DataFrame | None = None, task: bool = True, confirmed: DataFrame | None = None) -> DataFrame:
    """(id, confidence) without a query; ``confirmed`` is task_confirmation where it is at hand."""
    notes = corpus.notes
    rows = notes.select("id", "created_ms", "successes", "failures")
    if task and confirmed is None:
        confirmed = task_confirmation(notes, corpus.settings.confirmation)
    rows = rows.join(confirmed, "id", "left") if task else rows.withColumn("task", F.lit(0.0))
    rows = rows.join(drift, "id", "left") if drift is not None else rows.withColumn("drift", F.lit(0.0))
    age = age_factor(age_days(F.col("created_ms"), corpus.now_ms))
    zero = F.lit(0.0)
    value = confidence(zero, age, wilson(F.col("successes"), F.col("failures")), zero, F.coalesce("task", zero), F.coalesce("drift", zero))
    return rows.select("id", value.alias("confidence"))


def losers(corpus: Corpus, drift: DataFrame | None = None, task: bool = True, confirmed: DataFrame | None = None) -> DataFrame:
    """Notes that lose a contradiction: the side with less confidence, none at a tie, dangling links ignored."""
    pairs = corpus.edges.where("kind = 'contradicts'").select("src", "dst")
    c = written(base_confidence(corpus, drift, task, confirmed).withColumn("confidence", F.round("confidence", 9)))
    a, b = c.toDF("src", "_a"), c.toDF("dst", "_b")
    both = pairs.join(a, "src").join(b, "dst").where("_a <> _b")
    return both.select(F.when(F.col("_a") < F.col("_b"), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()


def rank(corpus: Corpus, f: Filter = Filter(), limit: int = 5, everything: bool = False) -> DataFrame:
    """Best notes by confidence alone."""
    notes = corpus.notes.where(f.shown() if everything else f.shown() & knowledge())
    confirmed = written(task_confirmation(corpus.notes, corpus.settings.confirmation))
    rows = notes.join(base_confidence(corpus, confirmed=confirmed), "id").join(losers(corpus, confirmed=confirmed).withColumn("_lost", F.lit(True)), "id", "left").join(confirmed, "id", "left")
    sure = F.round(F.when(F.col("_lost"), F.greatest(F.col("confidence") - 0.1, F.lit(0.0))).otherwise(F.col("confidence")), 6)
    task = F.coalesce("task", F.lit(0.0))
    stars = F.round(F.least(posterior_mean(F.col("successes"), F.col("failures")) + task, F.lit(1.0)), 6)
    why = F.when((F.col("successes") > 0) | (task > 0), "stars").otherwise("universal")
    out = rows.select("id", "statement", sure.alias("confidence"), why.alias("why"), stars.alias("stars")).orderBy(F.desc("confidence"), "id")
    return out.limit(limit) if limit else out
