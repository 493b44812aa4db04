"""Updates and links by value, with what follows from them."""

from lorewell.operators import revisions
from tests.test_operators import note

SCHEMA = "id string, type string, statement string, body string, tags array<string>, anchors array<string>, classification string, status string, scope string, created_ms long, successes double, failures double, reviews long, last_ms long, superseded_by string, revision int"


def make(spark, *rows):
    return spark.createDataFrame([(*r, v) for r, v in rows], SCHEMA)


def derived(spark, kind, statement):
    from lorewell.functions.ids import note_id
    from pyspark.sql import functions as F

    return spark.range(1).select(note_id(F.lit(kind), F.lit(statement))).first()[0]


def test_patches_revise_supersede_and_are_guarded(spark):
    one, two = derived(spark, "fact", "one"), derived(spark, "fact", "two")
    notes = make(spark, (note(one, "one", "b"), 3), (note("legacy", "old words", "b"), None), (note("x", "x", "b"), 0))
    edges = spark.createDataFrame([(one, "references", "x"), (one, "replaces", "x")], "src string, kind string, dst string")
    patches = [(1, one, None, "two", None, None), (2, "legacy", None, None, "new body", None), (3, "x", None, None, "c", "00000000"), (4, "none", None, "s", None, None), (5, one, None, None, "later", None), (6, "x", None, "two", None, None)]
    o = revisions.updated(notes, edges, spark.createDataFrame(patches, "line long, id string, type string, statement string, body string, expected_hash string"), 77)
    got = {r.line: (r.new_id, r.action, r.revision, r.problem) for r in o.outcomes.collect()}
    assert got == {1: (two, "superseded", 4, None), 2: (None, "revised", 1, None), 3: (None, None, None, "another hash"), 4: (None, None, None, "unknown id"), 5: (None, None, None, "patched twice"), 6: (None, None, None, "patched twice")}
    rows = {r.id: r for r in o.notes.collect()}
    assert set(rows) == {one, two, "legacy", "x"}
    assert (rows[one].status, rows[one].superseded_by, rows[one].revision, rows[one].statement) == ("superseded", two, 4, "one")
    assert (rows[two].status, rows[two].superseded_by, rows[two].revision, rows[two].created_ms, rows[two].statement, rows[two].body) == ("active", None, None, 77, "two", "b")
    assert (rows["legacy"].body, rows["legacy"].revision, rows["x"].body) == ("new body", 1, "b")
    assert {(r.src, r.kind, r.dst) for r in o.edges.collect()} == {(one, "references", "x"), (one, "replaces", "x"), (two, "references", "x"), (two, "replaces", one)}
    assert {(r.op, r.note_id, r.at, r.new_id) for r in o.events.collect()} == {("supersede", one, 77, two), ("update", "legacy", 77, None)}


def test_an_id_is_given_once(spark):
    two = derived(spark, "fact", "two")
    notes = make(spark, (note("a", "a"), 0), (note("b", "b"), 0), (note(derived(spark, "fact", "held"), "held"), 0))
    patches = [(1, "a", None, "two", None, None), (2, "b", None, "two", None, None), (3, derived(spark, "fact", "held"), None, "held", "same", None)]
    o = revisions.updated(notes, spark.createDataFrame([], "src string, kind string, dst string"), spark.createDataFrame(patches, "line long, id string, type string, statement string, body string, expected_hash string"), 1)
    assert {r.line: (r.new_id, r.problem) for r in o.outcomes.collect()} == {1: (two, None), 2: (None, "id is taken"), 3: (None, None)}


def test_links_point_back(spark):
    notes = make(spark, (note("a"), 1), (note("b"), None), (note("c"), 0), (note("d"), 0))
    edges = spark.createDataFrame([("a", "related", "b")], "src string, kind string, dst string")
    links = [(1, "a", "related", "b"), (2, "a", "replaces", "b"), (3, "c", "replaces", "b"), (4, "a", "related", "a"), (5, "a", "odd", "b"), (6, "no", "related", "a"), (7, "a", "related", "gone"), (8, "a", "related", "gone")]
    after, now, out = revisions.linked(notes, edges, spark.createDataFrame(links, "line long, src string, kind string, dst string"))
    assert {r.line: (r.problem, r.new) for r in out.collect()} == {
        1: (None, False), 2: (None, True), 3: (None, True), 4: ("to itself", False), 5: ("unknown kind", False), 6: ("no such note", False), 7: (None, True), 8: (None, False)}
    assert {r.id: (r.status, r.superseded_by, r.revision) for r in after.collect()} == {"a": ("active", None, 3), "b": ("superseded", "c", 2), "c": ("active", None, 1), "d": ("active", None, 0)}
    assert now.count() == 4
