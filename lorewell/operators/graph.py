"""Graph operators over edges (src, dst): closure, layers, cycles, rank, classes, views, impact, paths, trees, integrity.

Loops write each step's table (no lineage grows, a lost executor costs a reread) and stop on an empty frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.ids import EDGE_KINDS
from lorewell.functions.runtime import written
from lorewell.operators import paths
from lorewell.operators.filters import is_open, satisfied, work_item


def of_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every node that a source (all nodes, unless given as src) reaches in one step or more."""
    edges = written(edges.select("src", "dst").distinct())
    frontier = edges.join(sources, "src", "left_semi") if sources is not None else edges
    frontier = total = written(frontier)
    step = edges.toDF("_mid", "_to")
    while True:
        new = frontier.join(step, F.col("dst") == F.col("_mid")).select("src", F.col("_to").alias("dst")).distinct().join(total, ["src", "dst"], "left_anti")
        frontier = written(new)
        if frontier.isEmpty():
            return total
        total = total.union(frontier)


def downstream(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Nodes (id) that reach a marked node (id) along src -> dst in one step or more; each node is visited once."""
    edges = written(edges.select("src", "dst").distinct())
    frontier, parts = marked.select("id").distinct(), None
    while True:
        new = edges.join(frontier, edges["dst"] == frontier["id"], "left_semi").select(F.col("src").alias("id")).distinct()
        new = written(new.join(parts, "id", "left_anti") if parts is not None else new)
        if new.isEmpty():
            return parts if parts is not None else new
        parts = new if parts is None else parts.union(new)
        frontier = new


def expand(edges: DataFrame, start: str, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """(id, depth, via, parent): breadth first from one note; a node belongs to the first parent, then kind, that finds it."""
    spark = edges.sparkSession
    order = F.create_map(*[x for i, k in enumerate(EDGE_KINDS) for x in (F.lit(k), F.lit(i))])
    rows = edges.where(F.col("kind").isin(*(kinds or EDGE_KINDS)))
    seen = spark.createDataFrame([(start, 0, None, None)], "id string, depth int, via string, parent string")
    frontier = seen
    for level in range(1, depth + 1):
        found = rows.join(frontier.select(F.col("id").alias("src")), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        first = W.partitionBy("dst").orderBy("src", order[F.col("kind")])
        frontier = written(found.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(F.col("dst").alias("id"), F.lit(level).alias("depth"), F.col("kind").alias("via"), F.col("src").alias("parent")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


#: A cyclic core of up to so many edges is solved on the driver, in memory that this bounds; a larger one by labels that flow.
CORE = 20_000


def _trimmed(core: DataFrame) -> tuple[DataFrame, int]:
    """Edges that are left when nodes without a way in or out are peeled off, again and again, and their number."""
    before, now = -1, core.count()
    while now != before and now:
        core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = written(core.select("src", "dst"))
        before, now = now, core.count()
    return core, now


def _strong(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, smallest node of its strongly connected component) of the nodes on cycles, of a bounded number of edges."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)

    def reach(start: str, way: dict[str, list[str]], within: set[str]) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for x in way.get(todo.pop(), ()):
                if x in within and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    found, work = [], [set(out) | set(back)]
    while work:
        nodes = work.pop()
        if not nodes:
            continue
        pivot = min(nodes)
        ahead, behind = reach(pivot, out, nodes), reach(pivot, back, nodes)
        ring = ahead & behind
        found += [(x, min(ring)) for x in ring]
        ring.add(pivot)
        work += [ahead - ring, behind - ring, nodes - ahead - behind - ring]
    return found


def cyclic(edges: DataFrame, small: int = CORE) -> DataFrame:
    """(id, component): nodes on a cycle, named by the smallest id of their strongly connected component; self-loops count.

    Nodes without a way in or out are peeled off first. In a large core each node takes the smallest id that reaches it; among nodes
    with one label, those that reach the label's node are its component. What is found is taken out, until no core is left.
    No pairs of nodes are made, so a component of n nodes costs n rows a step.
    """
    core, size = _trimmed(written(edges.select("src", "dst").distinct()))
    fields = "id string, component string"
    out = edges.sparkSession.createDataFrame([], fields)
    while size > small:
        label = written(core.select(F.col("src").alias("id")).union(core.select("dst")).distinct().withColumn("label", F.col("id")))
        while True:
            told = core.join(label, core["src"] == label["id"]).select(F.col("dst").alias("id"), "label")
            new = written(label.union(told).groupBy("id").agg(F.min("label").alias("label")))
            done = new.exceptAll(label).isEmpty()
            label = new
            if done:
                break
        a, b = label.toDF("src", "_a"), label.toDF("dst", "_b")
        own = written(core.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst", F.col("_a").alias("component")))
        # nodes that reach their label's node, one step or more
        front = part = written(own.where("dst = component").select(F.col("src").alias("id"), "component").distinct())
        while not front.isEmpty():
            more = own.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "component").distinct().join(part, "id", "left_anti")
            front = written(more)
            part = part.union(front)
        part = written(part)
        out = out.union(part)
        gone = part.select("id").union(label.where("id = label").select("id")).distinct()
        left = core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        core, size = _trimmed(written(left.select("src", "dst")))
    few = [(r.src, r.dst) for r in core.collect()] if size else []
    return out.union(edges.sparkSession.createDataFrame(_strong(few), fields)) if few else out


def classes(edges: DataFrame) -> DataFrame:
    """(id, representative): connected components of undirected edges, by their smallest id.

    Large-star and small-star rounds: every node hands its larger, then its smaller neighbours to the smallest.
    """
    now = written(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("m"))
        up = both.where("dst > src").join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = up.groupBy("src").agg(F.min("dst").alias("m"))
        new = written(up.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", "m")).distinct())
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new.select(F.col("src").alias("id"), F.col("dst").alias("representative")).union(new.select(F.col("dst"), F.col("dst"))).distinct()
        now = new


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, steps: int = 32, stop: float = 1e-12) -> DataFrame:
    """(id, rank): power iteration from 1/n; what dangling nodes hold goes to the seeds, or to all nodes without seeds.

    One job a step: what arrives (a row per node) is written, and the dangling mass is what has not arrived. Nodes are joined
    by sorting: a broadcast would send them through the driver in every step.
    """
    known = nodes.select("id")
    links = edges.select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degree = links.groupBy("src").agg(F.count("*").alias("_d"))
    links = written(links.join(degree, "src"))
    n = known.count()
    if n == 0:
        return known.withColumn("rank", F.lit(0.0))
    if seeds is not None and not (chosen := known.join(seeds, "id", "left_semi")).isEmpty():
        personal = known.join(chosen.withColumn("_p", F.lit(1.0 / chosen.count())), "id", "left").select("id", F.coalesce("_p", F.lit(0.0)).alias("_p"))
    else:
        personal = known.withColumn("_p", F.lit(1.0 / n))
    personal = written(personal)
    start = 1.0 / n
    came: DataFrame | None = None
    for step in range(steps):
        rank = _ranked(personal, came, damping, start)
        sent = links.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("_r")).hint("merge"), "src")
        now = written(sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("_r") / F.col("_d")).alias("_c")))
        if step % 8 == 7:
            moved = _ranked(personal, now, damping, start).join(rank.withColumnRenamed("rank", "_old").hint("merge"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            if moved < stop:
                came = now
                break
        came = now
    rank = _ranked(personal, came, damping, start)
    return rank.select("id", "rank")


def _ranked(personal: DataFrame, came: DataFrame | None, damping: float, start: float) -> DataFrame:
    """(id, rank) from what arrived at each node; the mass that did not arrive is dangling."""
    if came is None:
        return personal.select("id", F.lit(start).alias("rank"))
    whole = came.agg(F.coalesce(F.sum("_c"), F.lit(0.0)).alias("_all"))
    rows = personal.join(came.hint("merge"), "id", "left").join(F.broadcast(whole), F.lit(True))
    value = F.col("_p") * (1 - damping) + (F.coalesce("_c", F.lit(0.0)) + (F.lit(1.0) - F.col("_all")) * F.col("_p")) * damping
    return rows.select("id", value.alias("rank"))


def views(corpus: Corpus) -> DataFrame:
    """(id, state, reason): work items, ready or blocked; reason is cycle, or the smallest id still to be satisfied."""
    notes = corpus.notes
    depends = written(of_kind(corpus.edges, "depends_on"))
    on_cycle = cyclic(depends).select("id", F.lit(True).alias("_cycle"))
    met = notes.where(satisfied()).select(F.col("id").alias("dst"))
    open_ = depends.select("dst").distinct().join(met, "dst", "left_anti").select(F.col("dst").alias("id"))
    pending = waiting(depends, open_)
    items = notes.where(work_item()).select("id")
    rows = items.join(on_cycle, "id", "left").join(pending, "id", "left")
    reason = F.when(F.col("_cycle"), "cycle").otherwise(F.col("pending"))
    return rows.select("id", F.when(reason.isNotNull(), "blocked").otherwise("ready").alias("state"), reason.alias("reason"))


def waiting(depends: DataFrame, open_: DataFrame) -> DataFrame:
    """(id, pending): the smallest open node that each node depends on, directly or not; labels flow back until none falls."""
    least = written(depends.join(open_.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("pending")))
    while True:
        told = depends.join(least.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "pending")
        new = written(least.union(told).groupBy("id").agg(F.min("pending").alias("pending")))
        if new.exceptAll(least).isEmpty():
            return new
        least = new


def impact(corpus: Corpus) -> DataFrame:
    """(id, impact): how many open work items depend on a note, directly or not; itself excluded."""
    sources = corpus.notes.where(work_item() & is_open()).select(F.col("id").alias("src"))
    reach = closure(of_kind(corpus.edges, "depends_on"), sources).where("src <> dst")
    return reach.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("impact"))


def uncut(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without the links within a cycle."""
    edges = written(edges.select("src", "dst").distinct())
    ring = written(cyclic(edges))
    a, b = ring.toDF("src", "_ca"), ring.toDF("dst", "_cb")
    return written(edges.join(a, "src", "left").join(b, "dst", "left").where("_ca is null or _cb is null or _ca <> _cb").select("src", "dst"))


def critical_path(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """(id, total, n, next): the longest chain of durations from each node along its dependencies; links within a cycle are cut."""
    return paths.longest(uncut(edges), durations)


def progress(corpus: Corpus, roots: DataFrame) -> DataFrame:
    """(root, total, done): leaf work items below each root, and those closed; an item on two ways counts twice. Links within a cycle are cut."""
    tree = of_kind(corpus.edges, "results_in")
    items = corpus.notes.where(work_item()).select("id", "status")
    inner = tree.join(items.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    leaves = items.join(inner, "id", "left_anti")
    below = paths.ways(uncut(tree), roots).join(leaves, "id")
    return below.groupBy("root").agg(F.sum("ways").alias("total"), F.sum(F.when(F.col("status") == "closed", F.col("ways")).otherwise(0)).alias("done"))


def parents(edges: DataFrame) -> DataFrame:
    """(id, parent): the smallest id whose results_in names the note."""
    return edges.where("kind = 'results_in'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def epic_of(corpus: Corpus, hops: int = 3) -> DataFrame:
    """(id, epic): the nearest ancestor of scope epic within ``hops`` parents; the note itself if it is one."""
    up = parents(corpus.edges)
    scope = corpus.notes.select(F.col("id").alias("_at"), F.col("scope").alias("_s"))
    rows = corpus.notes.select("id", F.col("id").alias("_at"), F.lit(None).cast("string").alias("epic"))
    for hop in range(hops + 1):
        rows = rows.join(scope, "_at", "left").withColumn("epic", F.coalesce("epic", F.when(F.col("_s") == "epic", F.col("_at")))).drop("_s")
        if hop < hops:
            rows = rows.join(up.toDF("_at", "_up"), "_at", "left").select("id", F.col("_up").alias("_at"), "epic")
    return rows.where("epic is not null").select("id", "epic")


def epic_around(corpus: Corpus, hops: int = 8) -> DataFrame:
    """(id, epic): the nearest ancestor of scope epic, else the nearest epic along depends_on, the smaller id at a tie."""
    up = epic_of(corpus, hops)
    depends = of_kind(corpus.edges, "depends_on")
    marked = corpus.notes.where("scope = 'epic'").select("id", F.col("id").alias("epic"))
    found = level = written(marked)
    while True:
        told = depends.join(level.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("epic").alias("epic"))
        level = written(told.join(found.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        found = found.union(level)
    return up.union(found.join(up, "id", "left_anti").join(corpus.notes.select("id"), "id", "left_semi").select("id", "epic"))


def subtree(corpus: Corpus, root: str) -> DataFrame:
    """(id, depth, position): the tree below a note in preorder, children by id."""
    start = corpus.notes.sparkSession.createDataFrame([(root,)], "id string")
    return paths.preorder(of_kind(corpus.edges, "results_in"), start)


def integrity(corpus: Corpus) -> DataFrame:
    """(issue, src, dst, kind): dangling and self edges, and supersessions that only one side knows."""
    notes, edges = corpus.notes, corpus.edges.distinct()
    ids = notes.select(F.col("id").alias("dst"))
    own = edges.where("src = dst").select(F.lit("self_edge").alias("issue"), "src", "dst", "kind")
    gone = edges.where("src <> dst").join(ids, "dst", "left_anti").select(F.lit("dangling").alias("issue"), "src", "dst", "kind")
    replaced = notes.where("superseded_by is not null").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"))
    lost = replaced.join(ids, "dst", "left_anti").select(F.lit("dangling").alias("issue"), "src", "dst", F.lit("replaces").alias("kind"))
    told = edges.where("kind = 'replaces'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    forward = replaced.join(ids, "dst", "left_semi").join(told, ["src", "dst"], "left_anti").select(F.lit("missing_forward").alias("issue"), "src", "dst", F.lit("replaces").alias("kind"))
    claims = edges.where("kind = 'replaces'").select("src", "dst").join(ids, "dst", "left_semi")
    back = claims.join(replaced.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_anti").select(F.lit("missing_backref").alias("issue"), "src", "dst", F.lit("replaces").alias("kind"))
    return own.union(gone).union(lost).union(forward).union(back)


def defeated(corpus: Corpus) -> DataFrame:
    """(id): notes that depend on a retracted one, directly or not, and all targets of replaces."""
    gone = corpus.notes.where(F.col("status").isin("superseded", "forgotten")).select("id")
    fallen = downstream(of_kind(corpus.edges, "depends_on"), gone).join(gone, "id", "left_anti")
    return fallen.union(of_kind(corpus.edges, "replaces").select(F.col("dst").alias("id"))).distinct()


def in_scope(corpus: Corpus, container: str) -> DataFrame:
    """(id): the container, what it reaches down results_in, and what reaches it up depends_on."""
    spark = corpus.notes.sparkSession
    start = spark.createDataFrame([(container,)], "id string")
    down = closure(of_kind(corpus.edges, "results_in"), start.withColumnRenamed("id", "src")).select(F.col("dst").alias("id"))
    up = downstream(of_kind(corpus.edges, "depends_on"), start)
    return start.union(down).union(up).distinct()


def broader(edges: DataFrame) -> DataFrame:
    """(src, dst): dst is broader than src, by a broader link or by a narrower one the other way round."""
    there = of_kind(edges, "broader").select("src", "dst")
    return there.union(of_kind(edges, "narrower").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hierarchy(edges: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(src, dst): all that is broader than a note (of ``notes``, if given), directly or not; read backwards, all that is narrower. On a cycle a note is its own."""
    return closure(broader(edges), None if notes is None else notes.select(F.col("id").alias("src")))


def hierarchy_cycles(edges: DataFrame) -> DataFrame:
    """(id, component): notes on cycles of broader and narrower links; a hierarchy has none."""
    return cyclic(broader(edges))


def in_scopes(corpus: Corpus, containers: DataFrame) -> DataFrame:
    """(id): the members of any of the containers (id); each note is visited once."""
    start = written(containers.select("id").distinct())
    up = of_kind(corpus.edges, "results_in").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return start.union(downstream(up, start)).union(downstream(of_kind(corpus.edges, "depends_on"), start)).distinct()


def claim_conflicts(notes: DataFrame) -> DataFrame:
    """(subject, relation, objects, ids): claims that give one subject and relation several objects."""
    c = notes.select("id", F.explode("claims").alias("c")).select("id", "c.subject", "c.relation", "c.object")
    several = c.groupBy("subject", "relation").agg(F.countDistinct("object").alias("n_objects"), F.countDistinct("id").alias("n_notes"), F.min("object").alias("first_object"))
    return several.where("n_objects > 1")


def missing_edges(edges: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggested (src, dst) that no edge has."""
    return suggested.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
