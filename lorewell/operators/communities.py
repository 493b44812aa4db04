"""Communities of high modularity, by rounds of moves that are joins and sums over the whole graph.

A round weighs every node against every community that it touches, in three joins and three sums. The joins sort: a broadcast
would send all nodes through the driver in every round. Of the nodes that would gain by moving, a share chosen by a hash of node
and round moves at once; a round whose outcome is no better than the best one so far is taken back and tried with a smaller share,
so modularity never falls. When rounds gain little, communities become the nodes of the next level, and at the end single nodes
move once more between the communities found. No component, community or node is one group: all sums are combined before they
are shuffled.

The result depends on the graph alone: weights are whole numbers, ties go to the smallest node, shares to a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.runtime import numbered, written

#: The share of movers that go in a round (1 in SHARE), and the least share that is tried.
SHARE, LEAST_SHARE = 2, 32
LEVELS = 8
#: Rounds of a level at most, and the modularity that a round adds at least for the next one to follow; of the levels, and of the last moves of single nodes.
COARSE, FINE = (10, 2e-3), (24, 1e-4)
MARGIN = 1e-9


def _both_ways(graph: DataFrame) -> DataFrame:
    """(u, v, w) of both directions of (a, b, w); a loop once, with twice its weight."""
    there = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), F.when(F.col("a") == F.col("b"), F.col("w") * 2).otherwise(F.col("w")).alias("w"))
    return there.union(graph.where("a <> b").select("b", "a", "w"))


def _nodes(links: DataFrame) -> DataFrame:
    """(u, degree, loop) of all nodes."""
    return links.groupBy("u").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loop"))


def _ties(links: DataFrame) -> DataFrame:
    """(u, v, w) of links to other nodes, and of each node to itself with no weight."""
    return links.where("u <> v").union(links.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w")).distinct())


def _weighed(ties: DataFrame, labels: DataFrame, mass: float) -> DataFrame:
    """(u, label, degree, loop, inner, total, target) of each node of labels (u, label, degree, loop).

    inner: weight of its links inside its community; total: its community's degrees; target: the community, if any, where it gains most.
    """
    size = labels.groupBy(F.col("label").alias("at")).agg(F.sum("degree").alias("total"), F.count("*").alias("n"))
    ends = labels.select(F.col("u").alias("v"), F.col("label").alias("at")).join(size.hint("merge"), "at")
    pull = ties.join(ends.hint("merge"), "v").groupBy("u", "at").agg(F.sum("w").alias("w"), F.max("total").alias("total"), F.max("n").alias("n"))
    rows = pull.join(labels.hint("merge"), "u")
    stays = F.col("at") == F.col("label")
    rest = F.when(stays, F.col("total") - F.col("degree")).otherwise(F.col("total"))
    rows = rows.withColumn("gain", F.col("w") - F.col("degree") * rest / F.lit(mass))
    best = rows.groupBy("u").agg(
        F.max(F.when(stays, F.struct("gain", "w", "total", "n", "label", "degree", "loop"))).alias("s"), F.max(F.when(~stays, F.struct("gain", (-F.col("at")).alias("to"), "n"))).alias("m")
    )
    gains = F.col("m.gain") > F.col("s.gain") + MARGIN
    swaps = (F.col("m.n") == 1) & (F.col("s.n") == 1) & (-F.col("m.to") > F.col("s.label"))  # of two single nodes one goes to the other
    return best.select("u", "s.label", "s.degree", "s.loop", F.col("s.w").alias("inner"), "s.total", F.when(gains & ~swaps, -F.col("m.to")).alias("target"))


def _settled(links: DataFrame, labels: DataFrame, mass: float, rounds: int, least: float) -> tuple[DataFrame, float]:
    """(u, label, ...) after rounds of moves, and its modularity."""
    best, top, share = None, float("-inf"), SHARE
    ties = written(_ties(links))
    for k in range(rounds):
        state = written(_weighed(ties, labels, mass))
        inside = (F.col("inner") + F.col("loop")) / mass - F.col("degree") / mass * (F.col("total") / mass)
        q, movers = state.agg(F.sum(inside), F.count("target")).first()
        if best is None or q > top + MARGIN:
            little = best is not None and q - top < least
            best, top, share = state, q, SHARE
            if not movers or little:
                break
        elif share >= LEAST_SHARE:
            break
        else:
            share *= 4
        goes = F.col("target").isNotNull() & (F.pmod(F.xxhash64("u", F.lit(k)), F.lit(share)) == 0)
        labels = best.select("u", F.when(goes, F.col("target")).otherwise(F.col("label")).alias("label"), "degree", "loop")
    return best, top


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Modularity of labels (u, label) on links (u, v, w) in both directions."""
    ends = links.join(labels.hint("merge"), "u").join(labels.toDF("v", "other").hint("merge"), "v")
    inner, mass = ends.agg(F.sum(F.when(F.col("label") == F.col("other"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    if not mass:
        return 0.0
    square = links.join(labels.hint("merge"), "u").groupBy("label").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") / mass * (F.col("t") / mass))).first()[0]
    return inner / mass - square


def partition(graph: DataFrame) -> DataFrame:
    """(u, label) of the nodes of a graph (a, b: long; w: whole numbers as doubles, one row for an unordered pair)."""
    first = links = written(_both_ways(graph))
    mass = links.agg(F.sum("w")).first()[0]
    if not mass:
        return first.select("u", F.col("u").alias("label"))
    found = None
    for _ in range(LEVELS):
        nodes = _nodes(links)
        state, _ = _settled(links, nodes.select("u", F.col("u").alias("label"), "degree", "loop"), mass, *COARSE)
        step = state.select("u", "label")
        found = step if found is None else written(found.join(step.toDF("label", "_next").hint("merge"), "label").select("u", F.col("_next").alias("label")))
        if step.where("u <> label").isEmpty():
            break
        links = written(links.join(step.hint("merge"), "u").join(step.toDF("v", "_v").hint("merge"), "v").groupBy(F.col("label").alias("u"), F.col("_v").alias("v")).agg(F.sum("w").alias("w")))
    state, _ = _settled(first, found.join(_nodes(first).hint("merge"), "u").select("u", "label", "degree", "loop"), mass, *FINE)
    return state.select("u", "label")


def communities(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """(community, id): communities of a graph (a, b, w) of notes, named by their smallest id; notes without links are alone."""
    names = written(numbered(notes.select("id").distinct(), "id"))
    at = lambda c: names.select(F.col("id").alias(c), F.col("position").alias(f"_{c}")).hint("merge")
    pairs = graph.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("w").cast("double").alias("w"))
    of = written(names.join(partition(pairs).withColumnRenamed("u", "position").hint("merge"), "position", "left").withColumn("label", F.coalesce("label", "position")))
    least = of.groupBy("label").agg(F.min("id").alias("community"))
    return of.join(least.hint("merge"), "label").select("community", "id")


def found(corpus: Corpus) -> DataFrame:
    """Communities of the corpus' weighted graph of links and shared anchors."""
    from lorewell.operators.semantic import weighted_graph

    return communities(corpus.notes, written(weighted_graph(corpus)))
