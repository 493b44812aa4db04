import random

from pyspark.sql import functions as F

from lorewell.corpus import Corpus, Settings
from lorewell.operators import communities, confidence, dedup, filters, flow, graph, lifecycle, paths, retrieval, semantic, writes

NOTE = "id string, type string, statement string, body string, tags array<string>, anchors array<string>, classification string, status string, scope string, created_ms long, successes double, failures double, reviews long, last_ms long, superseded_by string"


def note(i, statement="", body="", kind="fact", tags=(), anchors=(), cls="tactical", status="active", scope=None, at=0, s=0.0, f=0.0, sup=None):
    return (i, kind, statement, body, list(tags), list(anchors), cls, status, scope, at, float(s), float(f), int(s), None, sup)


def corpus(spark, notes, edges=(), now=0, events=(), paths=()):
    return Corpus(
        spark.createDataFrame(list(notes), NOTE), spark.createDataFrame(list(edges), "src string, kind string, dst string"), now,
        spark.createDataFrame(list(events), "event_id long, op string, note_id string, at long, action string, kind string, dst string"), None, spark.createDataFrame([(p,) for p in paths], "path string"),
    )


def test_bm25_prefers_statements_and_rare_terms(spark):
    c = corpus(spark, [note("a", "kernel panic"), note("b", "other", "kernel panic"), note("c", "kernel"), *[note(f"x{i}", "kernel noise") for i in range(5)]])
    ids = [r.id for r in retrieval.top(retrieval.bm25(c.notes, "kernel panic"), "score", 3).collect()]
    assert ids[:2] == ["a", "b"]
    assert retrieval.bm25(c.notes, "the of").count() == 0
    assert retrieval.bm25(c.notes.limit(0), "kernel").count() == 0


def test_same_stem_counts_twice(spark):
    c = corpus(spark, [note("a", "gato"), note("b", "cachorro")])
    once = retrieval.bm25(c.notes, "gato").first().score
    assert abs(retrieval.bm25(c.notes, "gato gatos").first().score - 2 * once) < 1e-9


def test_high_frequency_cut(spark):
    many = [note(f"n{i:03}", "common rare" if i == 0 else "common") for i in range(64)]
    assert retrieval.bm25(corpus(spark, many).notes, "common").count() == 0
    assert retrieval.bm25(corpus(spark, many[:63]).notes, "common").count() == 63
    assert retrieval.bm25(corpus(spark, many).notes, "common", 0).count() == 64


def test_fusion(spark):
    ch = spark.createDataFrame([("a", "lexical", 0), ("b", "lexical", 1), ("b", "anchor", 0)], "id string, channel string, rank int")
    got = {r.id: r.score for r in retrieval.fuse(ch, {"lexical": 1.0, "anchor": 2.0}).collect()}
    assert abs(got["a"] - 1 / 61) < 1e-12 and abs(got["b"] - (1 / 62 + 2 / 61)) < 1e-12


def test_task_confirmation_saturates_and_crosses_globs(spark):
    tasks = [note(f"t{i:02}", kind="task", scope="task", anchors=["src/a.rs"], s=1) for i in range(14)]
    c = corpus(spark, [note("k", anchors=["src/**"]), note("one", anchors=["lib/x.rs"]), note("g", kind="task", scope="task", anchors=["lib/*.rs"], s=1), note("none"), *tasks])
    got = {r.id: r.task for r in confidence.task_confirmation(c.notes).collect()}
    assert got["k"] == 1.0 and abs(got["one"] - 0.1) < 1e-12 and "none" not in got and abs(got["g"] - 0.1) < 1e-12


def test_glob_pairs_against_brute_force(spark):
    from lorewell.functions.globs import to_regex

    import re

    rnd = random.Random(3)
    part = lambda: rnd.choice(["a", "b", "ab", "*", "?", "**", "a*", "x.rs"])
    patterns = {"/".join(part() for _ in range(rnd.randrange(1, 4))) for _ in range(60)}
    paths = {"/".join(rnd.choice(["a", "b", "ab", "x.rs", "xars"]) for _ in range(rnd.randrange(1, 4))) for _ in range(60)} | {"/a", "a*"}
    got = {(r.pattern, r.path) for r in filters.glob_pairs(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {(p, t) for p in patterns for t in paths if p == t or re.match(to_regex(p), t)}


def test_contradictions_lose_or_tie(spark):
    c = corpus(spark, [note("a", s=3), note("b", s=1), note("c"), note("d")], [("a", "contradicts", "b"), ("c", "contradicts", "d"), ("a", "contradicts", "gone")])
    assert [r.id for r in confidence.losers(c).collect()] == ["b"]


def test_temporal_view(spark):
    log = [(1, "write", "a", 10, None, None, None), (2, "forget", "a", 20, None, None, None), (3, "restore", "a", 30, None, None, None), (4, "write", "b", 50, None, None, None), (5, "link", "b", 50, None, "replaces", "a")]
    c = corpus(spark, [note("a", at=10), note("b", at=50)], events=log)
    at = lambda t: {r.id for r in lifecycle.active_as_of(c, t).collect()}
    assert (at(15), at(25), at(35), at(40), at(60)) == ({"a"}, set(), {"a"}, {"a"}, {"b"})


def random_edges(rnd, n, m):
    return sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})


def reach(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), [a]
        while stack:
            for s, d in edges:
                if s == stack[-1] and d not in seen:
                    seen.add(d)
                    stack.insert(0, d)
            stack.pop()
        out[a] = seen
    return out


def test_graph_against_brute_force(spark):
    rnd = random.Random(11)
    for n, m in ((8, 10), (12, 14)):
        pairs = random_edges(rnd, n, m)
        edges = spark.createDataFrame(pairs, "src string, dst string")
        full = reach(pairs)
        assert {(r.src, r.dst) for r in graph.closure(edges).collect()} == {(a, b) for a, s in full.items() for b in s}
        rings = {a: min(b for b in full[a] if a in full[b]) for a in full if a in full[a]}
        assert {r.id: r.component for r in graph.cyclic(edges).collect()} == rings
        start = spark.createDataFrame([("n03",)], "id string")
        assert {r.id for r in graph.downstream(edges, start).collect()} == {a for a in full if "n03" in full[a]}
        both = reach(pairs + [(b, a) for a, b in pairs])
        links = {a for a, b in pairs if a != b} | {b for a, b in pairs if a != b}
        assert {r.id: r.representative for r in graph.classes(edges).collect()} == {a: min(both[a] | {a}) for a in links}


def test_pagerank_sums_to_one_and_finds_the_hub(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(8)], "id string")
    edges = spark.createDataFrame([(f"n{i}", "n0") for i in range(1, 8)] + [("n1", "n9")], "src string, dst string")
    ranks = {r.id: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "n0"
    seeded = {r.id: r.rank for r in graph.pagerank(nodes, edges, spark.createDataFrame([("n5",)], "id string")).collect()}
    assert seeded["n5"] > seeded["n4"] and abs(sum(seeded.values()) - 1) < 1e-9
    assert graph.pagerank(nodes.limit(0), edges).count() == 0


def test_views_and_reasons(spark):
    t = lambda i, **k: note(i, kind="task", scope="task", **k)
    c = corpus(spark, [t("a"), t("b"), t("c", status="closed"), t("d"), t("x"), t("y"), note("plain")], [("a", "depends_on", "b"), ("b", "depends_on", "c"), ("d", "depends_on", "gone"), ("x", "depends_on", "y"), ("y", "depends_on", "x")])
    got = {r.id: (r.state, r.reason) for r in graph.views(c).collect()}
    assert got == {"a": ("blocked", "b"), "b": ("ready", None), "c": ("ready", None), "d": ("blocked", "gone"), "x": ("blocked", "cycle"), "y": ("blocked", "cycle")}
    assert {r.id: r.impact for r in graph.impact(c).collect()} == {"b": 1, "c": 2, "gone": 1, "x": 1, "y": 1}


def test_critical_path_ties(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    length = spark.createDataFrame([("b", 5), ("c", 3), ("d", 2), ("a", 1), ("x", 4)], "id string, duration long")
    best = graph.critical_path(edges, length)
    assert {r.id: (r.total, r.n, r.next) for r in best.collect()} == {"a": (6, 3, "c"), "b": (5, 1, None), "c": (5, 2, "d"), "d": (2, 1, None), "x": (4, 1, None)}
    chain = paths.chains(best.select("id", "next"), best.where("id = 'a'").select("id"))
    assert [r.id for r in chain.orderBy("position").collect()] == ["a", "c", "d"]


def test_longest_paths_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(f"n{a:02}", f"n{b:02}") for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12]
    length = {f"n{i:02}": rng.randint(0, 3) for i in range(30)}

    def best(i):
        below = [best(b) for a, b in edges if a == i]
        t, n, way = min(((-t, -n, way) for t, n, way in below), default=(0, 0, []))
        return (length[i] - t, 1 - n, [i, *way])

    rows = graph.critical_path(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(length.items()), "id string, duration long"))
    assert {r.id: (r.total, r.n, r.next) for r in rows.collect()} == {i: (t, n, w[1] if n > 1 else None) for i in length for t, n, w in [best(i)]}


def test_chains_end_in_cycles_and_double(spark):
    follow = {f"c{i:03}": f"c{i + 1:03}" for i in range(99)} | {"x": "y", "y": "z", "z": "y", "o": "o"}
    rows = paths.chains(spark.createDataFrame(list(follow.items()), "id string, next string"), spark.createDataFrame([("c000",), ("c090",), ("x",), ("z",), ("o",), ("none",)], "id string"))
    got = {}
    for r in rows.orderBy("start", "position").collect():
        got.setdefault(r.start, []).append(r.id)
    assert got == {"c000": [f"c{i:03}" for i in range(100)], "c090": [f"c{i:03}" for i in range(90, 100)], "x": ["x", "y", "z"], "z": ["z", "y"], "o": ["o"], "none": ["none"]}


def test_ways_and_preorder_in_a_diamond_ladder(spark):
    """Forty diamonds in a row: 2^40 ways are counted, and the walk enters each node once."""
    edges = [e for i in range(40) for e in ((f"a{i:02}", f"b{i:02}"), (f"a{i:02}", f"c{i:02}"), (f"b{i:02}", f"a{i + 1:02}"), (f"c{i:02}", f"a{i + 1:02}"))]
    df, root = spark.createDataFrame(edges[:32], "src string, dst string"), spark.createDataFrame([("a00",)], "id string")
    assert {r.id: r.ways for r in paths.ways(df, root).collect()}["a08"] == 2**8
    order = [r.id for r in paths.preorder(df, root).orderBy("position").collect()]
    want, seen = [], set()

    def walk(i):
        seen.add(i)
        for b in sorted(b for a, b in edges[:32] if a == i):
            if b not in seen:
                want.append(b)
                walk(b)

    walk("a00")
    assert order == want


def test_communities_split_cliques(spark):
    clique = lambda p: [(f"{p}{i}", "references", f"{p}{j}") for i in range(4) for j in range(i)]
    c = corpus(spark, [note(f"{p}{i}", f"topic {p}word") for p in "abz" for i in range(4)], [*clique("a"), *clique("b"), ("a0", "references", "b0")])
    got = {r.id: r.community for r in communities.found(c).collect()}
    assert {got[f"a{i}"] for i in range(4)} == {"a0"} and {got[f"b{i}"] for i in range(4)} == {"b0"} and got["z2"] == "z2"
    terms = semantic.community_terms(c, communities.found(c)).where("community = 'a0' and position = 1").first()
    assert terms.term in ("aword", "topic")


def test_neighbours_and_complete_link(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    got = [(r.origin, r.id) for r in semantic.neighbours(v, v, 1, 0.5).orderBy("origin").collect()]
    assert got == [("a", "b"), ("b", "a")]
    assert [(r.a, r.b) for r in semantic.similar_pairs(v, 0.9).collect()] == [("a", "b")]
    parts = {r.id: r.part for r in semantic.complete_link(v.select(F.lit("k").alias("cluster"), "id"), v, 0.8, 2).collect()}
    assert parts["a"] == parts["b"] != parts["c"]


def test_similar_sets_against_brute_force(spark):
    rnd = random.Random(5)
    sets = {}
    for i in range(60):
        base = {f"t{k}" for k in range(rnd.randrange(0, 26))}
        sets[f"s{i:02}"] = sorted(base ^ {f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(3))})
    members, pairs = dedup.similar_sets(spark.createDataFrame(list(sets.items()), "id string, terms array<string>"), 0.92)
    of = {r.id: r["class"] for r in members.collect()}
    assert of == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1
    heads = sorted(set(of.values()))
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in heads for b in heads if a < b and dice(sets[a], sets[b]) >= 0.92}


def test_banding_finds_copies(spark):
    words = " ".join(f"term{i}" for i in range(40))
    c = corpus(spark, [note("a", words, at=2), note("b", words, at=1), note("c", words + " more"), note("d", "else")])
    got = {(r.keep, r.drop) for r in dedup.banded_proposals(c.notes).collect()}
    assert got >= {("b", "a")} and all("d" not in p for p in got)


def test_write_plan(spark):
    c = corpus(spark, [note("old", "alpha beta gamma delta", "epsilon zeta")])
    c = Corpus(c.notes.withColumn("body_hash", F.lit("h")), c.edges, 0)
    drafts = spark.createDataFrame([("1", "fact", "alpha beta gamma delta", "epsilon zeta", []), ("2", "fact", "alpha beta gamma delta", "epsilon other", []), ("3", "fact", "new", "thing", []), ("4", "task", "t", "", [])], "draft_id string, type string, statement string, body string, tags array<string>")
    assert {r.draft_id: (r.action, r.target) for r in writes.plan_writes(c.notes, drafts).collect()} == {"1": ("rejected", "old"), "2": ("merged", "old"), "3": ("created", None), "4": ("refused", None)}


def test_links_status_and_updates(spark):
    c = corpus(spark, [note("a", "s"), note("b", "t", status="superseded"), note("c", status="forgotten")])
    edges, bad = writes.linked(c.edges, spark.createDataFrame([("a", "supports", "b"), ("a", "supports", "b"), ("a", "related", "a"), ("a", "odd", "b")], "src string, kind string, dst string"))
    assert edges.count() == 1 and bad.count() == 2
    after, refused = writes.changed_status(c.notes, spark.createDataFrame([("a", "closed"), ("b", "active"), ("c", "active")], "id string, target string"))
    assert {r.id: r.status for r in after.collect()} == {"a": "closed", "b": "superseded", "c": "active"} and [r.id for r in refused.collect()] == ["b"]
    notes = c.notes.withColumn("revision", F.lit(1))
    got = {r.id: (r.action, r.revision) for r in writes.updated(notes, spark.createDataFrame([("a", None, "new words", None), ("b", None, None, "body")], "id string, type string, statement string, body string")).collect()}
    assert got == {"a": ("supersede", 1), "b": ("update", 2)}
    plan = spark.createDataFrame([("k", "task", "a"), ("m", "epic", "k"), ("n", "task", "nowhere")], "key string, scope string, parent string")
    assert {r.key: r.problem for r in writes.plan_tasks(spark.createDataFrame([("a", "epic")], "id string, scope string"), plan).collect()} == {"k": None, "m": "an epic has no parent", "n": "unknown parent"}


def test_merge_keeps_order_and_contained_bodies(spark):
    c = corpus(spark, [note("a", "s", "one two", tags=["x"], anchors=["p"])])
    inc = spark.createDataFrame([("a", ["y", "x"], ["q"], "two"), ("a", [], [], "three")], "target string, tags array<string>, anchors array<string>, body string")
    r = writes.merged(c.notes, inc).first()
    assert (r.tags, r.anchors, r.body) == (["x", "y"], ["p", "q"], "one two\n\nthree")


def test_flow_and_budget(spark):
    log = [(1, "write", "a", 10, None, None, None), (2, "task", "a", 40, "review", None, None), (3, "task", "a", 60, "review", None, None), (4, "write", "b", 20, None, None, None)]
    c = corpus(spark, [], events=log)
    r = flow.flow_summary(c.events, 100).first()
    assert (r.notes, r.closed, r.mean_cycle_ms, r.mean_lead_ms) == (2, 1, 50, 65)
    lines = spark.createDataFrame([(0, "x" * 400), (1, "y" * 4000), (2, "z")], "position int, line string")
    cut = flow.budget_cut(lines, 300).collect()
    assert [(r.position, len(r.line)) for r in cut] == [(0, 400), (1, 801)]
    assert [r.position for r in flow.budget_cut(lines, 150).collect()] == [0]


def test_outcomes_checks_and_gates(spark):
    checks = spark.createDataFrame([("a", True, "error"), ("b", False, "error"), ("c", False, "warning"), ("d", None, None)], "note_id string, passed boolean, severity string")
    assert {r.note_id: r.outcome for r in flow.outcome(checks).collect()} == {"a": "success", "b": "failure", "c": "partial", "d": "abandoned"}
    catalog = spark.createDataFrame([("lint", None), ("unit", "src/**"), ("docs", "docs/**")], "name string, scope string")
    got = {r.name: r.source for r in flow.resolved_checks(spark.createDataFrame([("lint",)], "name string"), catalog, spark.createDataFrame([("src/a.rs",)], "anchor string")).collect()}
    assert got == {"lint": "explicit", "unit": "anchor"}
    gates = spark.createDataFrame([("g", True, 0.5, 0.7), ("h", False, 0.0, 1.0)], "name string, passed boolean, before double, after double")
    assert [r.name for r in flow.accepted(gates, 0.1).collect()] == ["g"]


def test_settings_layers():
    assert Settings.of({"limit": 9, "unknown": 1}, {"limit": 7}).limit == 7


def test_cycles_of_a_large_core_equal_those_of_a_small_one(spark):
    """Labels that flow find the components that the driver finds."""
    import random

    rnd = random.Random(5)
    for n, m in ((12, 20), (30, 45), (40, 80)):
        edges = {(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        reach = {(a, b) for a, b in edges}
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        want = {(a, min(b for b in {x for _, x in reach} if (a, b) in reach and (b, a) in reach)) for a, b in reach if (b, a) in reach}
        assert {tuple(r) for r in graph.cyclic(df, small=0).collect()} == want == {tuple(r) for r in graph.cyclic(df).collect()}


def test_numbered_is_a_total_order(spark):
    from lorewell.functions.runtime import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 31).alias("v"), "id")
    got = [(r.v, r.id) for r in sorted(numbered(rows, F.desc("v"), F.col("id")).collect(), key=lambda r: r.position)]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 1000


def test_mentions_and_markers(spark):
    from lorewell.functions import text
    from lorewell.functions.ids import TYPES

    body = "Depende de fact_0000000a e [[def_0000000b]] risk_0000000c fact_0000000d. xfact_0000000a fact_0000000ab depende de  meta_00000000"
    df = spark.createDataFrame([(body,), ("",), (None,), ("fact_0000000a",)], "b string")
    got = [[tuple(m) for m in r.m] if r.m is not None else None for r in df.select(text.mentions("b", TYPES).alias("m")).collect()]
    assert got == [
        [("fact_0000000a", "depends_on", "verbo"), ("def_0000000b", "references", "wikilink"), ("risk_0000000c", "references", "menção"), ("fact_0000000d", "references", "menção"), ("meta_00000000", "depends_on", "verbo")],
        [], [], [("fact_0000000a", "references", "menção")],
    ]
    marked = spark.createDataFrame([("a\nb\n\n", "p1", 3), ("", "p2", None), (f"{text.MARKER} old blocks 7 -->\nx", "p3", None)], "b string, p string, n int")
    rows = marked.select(text.with_marker("b", F.col("p"), F.col("n")).alias("t")).select("t", text.parent_marker("t").alias("m"), text.without_marker("t").alias("w")).collect()
    assert [(r.m.parent, r.m.blocks, r.w) for r in rows] == [("p1", 3, "a\nb"), ("p2", None, ""), ("p3", None, "x")]


def test_a_report_over_everything_must_be_asked_for(spark):
    import pytest

    from lorewell.operators import tasks
    from lorewell.operators.filters import Filter

    with pytest.raises(ValueError):
        tasks.guarded(Filter())
    assert tasks.guarded(Filter(), universe=True) == Filter() and tasks.guarded(Filter(tags=("a",))).tags == ("a",)


def test_banding_equals_the_exact_join(spark):
    import random

    rnd = random.Random(2)
    base = [[f"term{rnd.randrange(4000)}" for _ in range(60)] for _ in range(8)]
    notes = []
    for i in range(80):
        words = list(base[i % 8])
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(60)] = f"other{rnd.randrange(4000)}"
        notes.append(note(f"n{i:03d}", " ".join(words), at=i))
    c = corpus(spark, notes)
    pairs = lambda df: {(r.keep, r.drop, round(r.score, 6)) for r in df.collect()}
    want = pairs(dedup.merge_proposals(c.notes))
    assert pairs(dedup.banded_proposals(c.notes)) == want and len(want) > 20


def test_as_of_recall_brings_back_what_was_active_then(spark):
    notes = [note("then", "kernel", status="forgotten", at=1), note("replaced", "kernel", status="superseded", at=1), note("gone", "kernel", status="active", at=1), note("later", "kernel", at=50), note("now", "kernel", at=1)]
    events = [(1, "forget", "gone", 5, None, None, None), (2, "forget", "then", 20, None, None, None), (3, "link", "now", 30, None, "replaces", "replaced"), (4, "restore", "gone", 40, None, None, None)]
    c = corpus(spark, notes, events=events, now=100)
    ids = lambda *a, **k: {r.id for r in retrieval.recall(c, "kernel", [], None, *a, limit=0, **k).collect()}
    assert ids() == {"gone", "later", "now"}
    assert ids(as_of=10) == {"then", "replaced", "now"}
    assert ids(as_of=45) == {"gone", "now"}
    assert ids(filters.Filter(statuses=("forgotten",)), as_of=10) == {"then"}


def test_whole_sets_are_fetched_only_for_pairs_that_may_be_similar(spark, monkeypatch):
    rnd = random.Random(3)
    rare = [f"rare{k}" for k in range(6)]  # all meet at these, none is similar
    sets = {f"s{i:03}": sorted({f"w{rnd.randrange(2000)}" for _ in range(60)} | set(rare)) for i in range(80)}
    sets |= {f"t{i:03}": sorted((set(sets[f"s{i:03}"]) - {rare[0]}) | {"added"}) for i in range(0, 80, 8)}
    tested = []
    scored = dedup._scored
    monkeypatch.setattr(dedup, "_scored", lambda pairs, first, least: tested.append(pairs.distinct().count()) or scored(pairs, first, least))
    _, pairs = dedup.similar_sets(spark.createDataFrame(list(sets.items()), "id string, terms array<string>"), 0.92)
    assert {(r.a, r.b) for r in pairs.collect()} == {(f"s{i:03}", f"t{i:03}") for i in range(0, 80, 8)}
    assert tested == [10]


def test_parts_of_a_cluster_of_thousands_follow_the_greedy_order(spark):
    import time

    import numpy as np

    rnd = np.random.default_rng(4)
    m = np.vstack([rnd.normal(size=(5000, 16)), np.zeros((1, 16))])
    m[1000:2000] = m[:1000] + rnd.normal(size=(1000, 16)) * 0.3
    v = spark.createDataFrame([(f"v{i:05}", [float(x) for x in row]) for i, row in enumerate(m)], "id string, vector array<double>")
    began = time.time()
    got = [r.part for r in semantic.complete_link(v.select(F.lit("k").alias("cluster"), "id"), v, 0.6, 2).orderBy("id").collect()]
    assert time.time() - began < 30
    u = semantic._unit(m)
    near = np.round(u @ u.T, 6) >= 0.6
    parts: list[list[int]] = []
    want = []
    for i in range(len(u)):
        p = next((p for p, own in enumerate(parts) if near[i, own].all()), len(parts))
        parts[p : p + 1] = [[*parts[p], i] if p < len(parts) else [i]]
        want.append(p)
    assert got == want and len(parts) < len(u)


def test_no_step_of_a_rank_broadcasts_its_nodes(spark, monkeypatch):
    plans = []
    written = graph.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(graph, "written", noted)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "id string")
    graph.pagerank(nodes, spark.createDataFrame([(f"n{i}", f"n{i // 2}") for i in range(1, 20)], "src string, dst string"), steps=3)
    steps = plans[2:]  # after the links and what each node gets anyway
    assert len(steps) == 3 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in steps)


def test_merge_strategy_finds_a_pair_that_shares_no_band_in_a_large_corpus(spark, tmp_path):
    from lorewell.plans.everything import QUERIES

    # dice 24 / 26, and another minimum of hashes in each of the 16 bands; 400 notes that share a term once made the query look at bands alone
    pair = ["\n" + " ".join(f"w324291x{k}" for k in range(start, start + 13)) for start in (0, 1)]
    texts = pair + [f"\nshared own{i}a own{i}b own{i}c" for i in range(400)]
    spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in QUERIES["merge_strategy"](spark, str(tmp_path)).collect()] == [("n0000000000", "n0000000001", 0.923077)]
