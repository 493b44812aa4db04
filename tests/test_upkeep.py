"""Upkeep and batches by value."""

from dataclasses import replace

from lorewell.corpus import Settings
from lorewell.operators import batch, upkeep
from lorewell.operators.graph import integrity
from tests.test_operators import corpus, note

DAY = 86_400_000
OPS = "line long, key string, id string, type string, scope string, statement string, parent string"


def test_purge_cascades_and_leaves_nothing_dangling(spark):
    notes = [note("old", status="forgotten"), note("new", sup="old"), note("back"), note("fresh", status="forgotten"), note("ring1", status="forgotten"), note("ring2"), note("other", sup="new")]
    edges = [("new", "references", "old"), ("old", "supports", "other"), ("new", "references", "other"), ("ring1", "depends_on", "ring2"), ("ring2", "depends_on", "ring1")]
    events = [(1, "forget", "old", 0, None, None, None), (2, "forget", "back", 0, None, None, None), (3, "restore", "back", 5, None, None, None), (4, "forget", "fresh", 20 * DAY, None, None, None), (5, "forget", "ring1", 0, None, None, None), (6, "forget", "never", 0, None, None, None)]
    c = corpus(spark, notes, edges, now=40 * DAY, events=events)
    c = replace(c, vectors=spark.createDataFrame([("old", [1.0]), ("new", [1.0])], "id string, vector array<double>"))
    before = integrity(c).count()
    left, told = upkeep.purged(c)
    assert [tuple(r) for r in told.collect()] == [("old", 0, "forget", 2, 1)]
    assert {r.id: r.superseded_by for r in left.notes.collect()} == {"new": None, "back": None, "fresh": None, "ring1": None, "ring2": None, "other": "new"}
    assert {(r.src, r.dst) for r in left.edges.collect()} == {("new", "other"), ("ring1", "ring2"), ("ring2", "ring1")}
    assert [r.id for r in left.vectors.collect()] == ["new"] and integrity(left).count() <= before
    assert upkeep.purged(left)[1].count() == 0


def test_thirteen_checks(spark):
    c = corpus(spark, [note("a", "same words here", "x"), note("b", "same words here", "x"), note("e", kind=None, scope="epic")], [("a", "depends_on", "b"), ("b", "depends_on", "a")], now=100_000)
    got = {r.check: (r.findings, r.ok, r.fixable) for r in upkeep.doctor(c, upkeep.Store()).collect()}
    assert list(got) == ["schema", "integrity", "cycles", "anchors", "program_anchor", "duplicates", "locks", "config", "body_hash", "events", "derived", "embeddings", "body"]
    assert got["cycles"][0] == 2 and got["duplicates"][0] == 1 and got["program_anchor"][0] == 1 and got["schema"] == (0, True, False) and got["derived"] == (0, True, True)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    store = upkeep.Store(
        skipped=df([("z",)], "id string"), records=df([("p", "1"), ("q", "1"), ("r", "1")], "path string, content_hash string"), files=df([("p", "1"), ("q", "2"), ("plan/a.md", "1")], "path string, content_hash string"),
        locks=df([("l", 0), ("m", 99_999)], "path string, taken_ms long"), bad_events=df([("{",)], "value string"), hashes=df([("a", "wrong"), ("b", None)], "id string, body_hash string"),
        derived=df([("a", "1"), ("x", "1")], "id string, digest string"), canonical=df([("a", "2"), ("b", "1")], "id string, digest string"), embedding_bytes=(upkeep.EMBEDDING_BYTES, upkeep.EMBEDDING_BYTES + 1),
    )
    got = {r.check: r.findings for r in upkeep.doctor(replace(c, settings=Settings(limit=0, link_low=0.9)), store).collect()}
    assert {k: got[k] for k in ("schema", "anchors", "program_anchor", "locks", "config", "body_hash", "events", "derived", "embeddings")} == {
        "schema": 1, "anchors": 2, "program_anchor": 2, "locks": 1, "config": 2, "body_hash": 1, "events": 1, "derived": 3, "embeddings": 1}


def test_batches_good_cyclic_and_unknown(spark):
    notes = [note("e1", kind="epic", scope="epic"), note("i1", kind="task", scope="issue"), note("t1", kind="task", scope="task"), note("t2", kind="task", scope="task"), note("i2", kind="task", scope="issue")]
    # an old tree in which a task holds an issue, as a link made by hand may
    c = corpus(spark, notes, [("e1", "results_in", "i1"), ("i1", "results_in", "t1"), ("t2", "results_in", "i2"), ("t1", "references", "t2")])
    ops = [
        (1, "k", None, "task", "issue", "new issue", "e1"), (2, None, None, "task", "task", "under new issue", "k"), (3, None, "t1", None, None, None, "k"), (4, None, "nope", None, None, None, "e1"), (5, "bad", None, "task", "issue", "lost", "nowhere"),
        (6, None, None, "task", "task", "its child", "bad"), (7, None, "t2", None, None, None, "i2"), (8, None, None, "task", "task", "early", "late"), (9, "late", None, "task", "issue", "too late", None), (10, None, "i1", None, None, None, "i2"), (11, "k", None, "task", "epic", "second of a key", None), (12, None, None, "task", "task", "takes the last key", "k"),
    ]
    done = batch.checked(c, spark.createDataFrame(ops, OPS))
    got = {r.line: (r.action, r.problem) for r in done.collect()}
    assert {k: v[1] for k, v in got.items()} == {
        1: None, 2: None, 3: None, 4: "unknown id", 5: "unknown parent", 6: "its parent is rejected", 7: "closes a cycle", 8: "unknown parent", 9: None, 10: "parent of no higher rank", 11: None, 12: None}
    by = {r.line: r for r in done.collect()}
    assert by[2].parent_id == by[3].parent_id == by[1].target and by[12].parent_id == by[11].target and got[3][0] == "updated"
    links = {(r.src, r.kind, r.dst) for r in batch.applied(c, done).collect()}
    assert (by[1].target, "results_in", "t1") in links and ("i1", "results_in", "t1") not in links and ("t1", "references", "t2") in links and ("t2", "results_in", "i2") in links
