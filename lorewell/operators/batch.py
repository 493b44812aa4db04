"""A batch of task changes, checked whole before any of it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.ids import note_id
from lorewell.functions.runtime import written
from lorewell.operators.filters import hierarchy_allowed
from lorewell.operators.graph import cyclic, downstream, parents

#: Ranks in the tree of work.
SCOPES = ("epic", "issue", "task")


def _targets(ops: DataFrame, notes: DataFrame) -> DataFrame:
    """The operations with the ids that they change or make, and the first problem of their own."""
    made = note_id(F.coalesce("type", F.lit("task")), F.col("statement"))
    rows = ops.withColumn("target", F.coalesce("id", made))
    known = notes.select(F.col("id").alias("target"), F.col("scope").alias("_old"), F.lit(True).alias("_known"))
    rows = rows.join(known, "target", "left").withColumn("scope", F.coalesce("scope", "_old", F.lit("task")))
    problem = (
        F.when(F.col("id").isNotNull() & F.col("_known").isNull(), "unknown id").when(F.col("id").isNull() & (F.trim(F.coalesce("statement", F.lit(""))) == ""), "no statement")
        .when(~F.col("scope").isin(*SCOPES), "no scope of work").when(F.col("id").isNull() & F.col("_known").isNotNull(), "exists")
    )
    again = F.row_number().over(W.partitionBy("target").orderBy("line")) > 1  # a note is changed once in a batch
    return rows.withColumn("problem", F.coalesce(problem, F.when(again, "changed twice"))).drop("_old", "_known")


def _resolved(rows: DataFrame) -> DataFrame:
    """Parents by local key where an earlier line has that key (the last one before), else by id; ``by`` is that line."""
    keys = rows.where(F.col("key").isNotNull()).select(F.col("key").alias("parent"), F.col("line").alias("by"), F.col("target").alias("_to"))
    ways = rows.where(F.col("parent").isNotNull()).select("line", "parent").join(keys, "parent").where(F.col("by") < F.col("line"))
    best = ways.groupBy("line").agg(F.max(F.struct("by", "_to")).alias("x")).select("line", "x.by", "x._to")
    return rows.join(best, "line", "left").withColumn("parent_id", F.coalesce("_to", "parent")).drop("_to")


def checked(corpus: Corpus, ops: DataFrame) -> DataFrame:
    """(line, key, action, target, scope, parent_id, problem) of operations (line, key, id, type, scope, statement, parent).

    Without an id a note is made, else changed; a parent is a key of an earlier line or an id. Rejected are unknown targets and parents, parents
    whose rank is no higher, parents whose own line is rejected, and moves that would close a cycle in the tree as it would be then: the old links
    but those of moved notes, and the new ones.
    """
    notes = corpus.notes
    rows = written(_resolved(_targets(ops, notes)))
    ranks = rows.select(F.col("line").alias("by"), F.col("scope").alias("_made"))
    held = notes.select(F.col("id").alias("parent_id"), F.col("scope").alias("_held"), F.lit(True).alias("_there"))
    rows = rows.join(ranks, "by", "left").join(held, "parent_id", "left").withColumn("_above", F.coalesce("_made", "_held"))
    moves = F.col("parent").isNotNull()
    own = F.when(moves & F.col("by").isNull() & F.col("_there").isNull(), "unknown parent").when(moves & ~hierarchy_allowed(F.col("_above"), F.col("scope")), "parent of no higher rank")
    rows = written(rows.withColumn("problem", F.coalesce("problem", own)).drop("_made", "_held", "_there", "_above"))

    wants = rows.where(moves & F.col("problem").isNull()).select(F.col("parent_id").alias("src"), F.col("target").alias("dst"), "line")
    old = parents(corpus.edges).select(F.col("parent").alias("src"), F.col("id").alias("dst")).join(wants.select("dst").distinct(), "dst", "left_anti").select("src", "dst")
    ring = cyclic(old.union(wants.select("src", "dst")))
    inside = wants.join(ring.toDF("src", "_a"), "src").join(ring.toDF("dst", "_b"), "dst").where("_a = _b").select("line", F.lit("closes a cycle").alias("_cycle"))
    rows = written(rows.join(inside, "line", "left").withColumn("problem", F.coalesce("problem", "_cycle")).drop("_cycle"))

    relies = rows.where(F.col("by").isNotNull()).select(F.col("line").cast("string").alias("src"), F.col("by").cast("string").alias("dst"))
    lost = downstream(relies, rows.where(F.col("problem").isNotNull()).select(F.col("line").cast("string").alias("id")))
    rows = rows.join(lost.select(F.col("id").cast("long").alias("line"), F.lit("its parent is rejected").alias("_lost")), "line", "left")
    action = F.when(F.col("id").isNull(), "created").otherwise("updated")
    return rows.select("line", "key", action.alias("action"), "target", "scope", "parent_id", F.coalesce("problem", "_lost").alias("problem"))


def applied(corpus: Corpus, done: DataFrame) -> DataFrame:
    """(src, kind, dst): the links after the accepted lines of ``checked``: moved notes have their new parent alone."""
    good = done.where(F.col("problem").isNull() & F.col("parent_id").isNotNull())
    moved = good.select(F.col("target").alias("dst"))
    tree = corpus.edges.where("kind = 'results_in'").join(moved, "dst", "left_anti").select("src", "kind", "dst")
    return corpus.edges.where("kind <> 'results_in'").select("src", "kind", "dst").union(tree).union(good.select(F.col("parent_id").alias("src"), F.lit("results_in").alias("kind"), F.col("target").alias("dst")))
