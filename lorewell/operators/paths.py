"""Ways through links: chains by doubling, longest paths by next-pointers, counted ways, preorder.

Chains of a pointer are laid out in as many rounds as their length has bits: each round doubles both how far a node's pointer
goes and how much of each chain is known. Nothing is looked up on the driver, and no row holds a path, but in ``preorder``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.runtime import numbered, written


def chains(follow: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, position, id): from each start (id) along its pointer (id, next; one per id), no node twice."""
    jump = written(follow.where(F.col("next").isNotNull()).select("id", "next"))
    known = written(starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("position"), "id").distinct())
    size, span = known.count(), 1
    while True:
        ahead = known.join(jump, "id").select("start", (F.col("position") + span).alias("position"), F.col("next").alias("id"))
        known = written(known.unionByName(ahead).groupBy("start", "id").agg(F.min("position").alias("position")).select("start", "position", "id"))
        now = known.count()
        if now == size:
            return known
        size, span = now, span * 2
        jump = written(jump.join(jump.toDF("next", "_then"), "next").select("id", F.col("_then").alias("next")))


def history(edges: DataFrame, notes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, step): from each start (id) back along its first replaces to the oldest note, and from that one forward along superseded_by."""
    older = edges.where("kind = 'replaces'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    first = written(chains(older, starts).groupBy("start").agg(F.max_by("id", "position").alias("root")))
    forward = chains(notes.select("id", F.col("superseded_by").alias("next")), first.select(F.col("root").alias("id")))
    return first.join(forward.withColumnRenamed("start", "root"), "root").select("start", "id", F.col("position").alias("step"))


def longest(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """(id, total, n, next): the longest chain of durations (id, duration) from each node along acyclic edges (src, dst): its sum, its nodes, and its next node.

    Ties: more nodes, then the smaller next id, which is the smaller path. Only nodes whose sum has changed are looked at again.
    """
    edges = written(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(durations.select("id")).distinct()
    best = written(nodes.join(durations, "id", "left").select("id", F.coalesce("duration", F.lit(0)).cast("long").alias("own")).select("id", "own", F.col("own").alias("total"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("next")))
    moved = best.select("id", "total", "n")
    while True:
        by = edges.join(moved.withColumnRenamed("id", "dst"), "dst")
        least = F.min(F.struct((-F.col("total")).alias("t"), (-F.col("n")).alias("n"), F.col("dst").alias("next"))).alias("c")
        offers = by.groupBy(F.col("src").alias("id")).agg(least)
        rows = best.join(offers, "id", "left").withColumn("_t", F.col("own") - F.col("c.t")).withColumn("_n", 1 - F.col("c.n"))
        same = (F.col("_t") == F.col("total")) & (F.col("_n") == F.col("n"))
        better = F.coalesce((F.col("_t") > F.col("total")) | ((F.col("_t") == F.col("total")) & (F.col("_n") > F.col("n"))) | (same & (F.col("c.next") < F.col("next"))), F.lit(False))
        grown = better & ~same
        pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old))
        best = written(rows.select("id", "own", pick("_t", "total").alias("total"), pick("_n", "n").alias("n"), pick("c.next", "next").alias("next"), grown.alias("_grown")))
        moved = best.where("_grown").select("id", "total", "n")
        best = best.drop("_grown")
        if moved.isEmpty():
            return best.select("id", "total", "n", "next")


def ways(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, ways): in how many ways each root (id) leads down acyclic edges to a node; ways are counted, not listed."""
    edges = written(edges.select("src", "dst").distinct())
    level = written(roots.select(F.col("id").alias("root"), "id", F.lit(1).cast("long").alias("ways")).distinct())
    levels = []
    while True:
        level = written(level.join(edges, level["id"] == edges["src"]).groupBy("root", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways")))
        levels.append(level)
        if level.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.groupBy("root", "id").agg(F.sum("ways").alias("ways"))


def preorder(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id, depth, position): what is below a root (id) in the order of a walk that enters children by id and no node twice.

    The walk comes to a node first by the smallest of its ways, so each node keeps that one way alone; places are numbered by ranges.
    """
    edges = written(edges.select("src", "dst").distinct())
    best = moved = written(root.select("id", F.array("id").alias("way")))
    while True:
        offers = moved.join(edges, moved["id"] == edges["src"]).where(~F.array_contains("way", F.col("dst"))).select(F.col("dst").alias("id"), F.concat("way", F.array("dst")).alias("new"))
        rows = best.join(offers.groupBy("id").agg(F.min("new").alias("new")), "id", "full")
        better = F.coalesce(F.col("way").isNull() | (F.col("new") < F.col("way")), F.lit(False))
        best = written(rows.select("id", F.when(better, F.col("new")).otherwise(F.col("way")).alias("way"), better.alias("_moved")))
        moved = best.where("_moved").select("id", "way")
        best = best.select("id", "way")
        if moved.isEmpty():
            break
    below = best.where(F.size("way") > 1).select("id", (F.size("way") - 1).alias("depth"), "way")
    return numbered(below, "way").select("id", "depth", F.col("position").cast("long").alias("position"))
