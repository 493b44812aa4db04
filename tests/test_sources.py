import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions.vectors import embedder
from lorewell.sources import logs, store, toon
from lorewell.streaming import drain, events

DOCUMENT = """id: fact_7a3c1b2d
type: fact
statement: Rust > JSON
created_at: 2026-01-02T03:04:05.678Z
confidence: 0.7
schema_version: 1
tags: [busca, sem-vector-db]
evidence:
  build: true
outcomes:
  - status: success
    duration: 120
"""


def test_toon_round_trip():
    assert toon.emit(toon.parse(DOCUMENT)) == DOCUMENT
    assert toon.parse("") == {} and toon.emit({}) == ""


@pytest.mark.parametrize(("src", "want"), [("n: -7", -7), ("f: 0.5", 0.5), ("b: true", True), ("s: a: b", "a: b"), ('q: "x\\ny"', "x\ny"), ('u: "\\u{41}"', "A"), ("l: [a, [1, 2], {k: v}]", ["a", [1, 2], {"k": "v"}]), ("m: {a: 1, b: x y}", {"a": 1, "b": "x y"}), ("e: []", []), ("c: 1  # note", 1), ("h: a#b", "a#b")])
def test_toon_values(src, want):
    assert next(iter(toon.parse(src).values())) == want


@pytest.mark.parametrize("src", ["a: 1\na: 2", "a:\n   b: 1", "a:\n\tb: 1", 'a: "x', "a: [1", "just text", 'a: "\\q"', "a: 1\n    b: 2"])
def test_toon_errors(src):
    with pytest.raises(toon.ToonError):
        toon.parse(src)


SCALAR = st.one_of(st.booleans(), st.integers(-(2**62), 2**62), st.text(st.characters(exclude_categories=("Cs",)), max_size=12))
VALUE = st.one_of(SCALAR, st.lists(SCALAR, min_size=1, max_size=3), st.dictionaries(st.from_regex(r"[a-z]{1,5}", fullmatch=True), SCALAR, min_size=1, max_size=3))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.from_regex(r"[a-z_]{1,6}", fullmatch=True), VALUE, max_size=5))
def test_toon_round_trips_values(value):
    assert toon.parse(toon.emit(value)) == value


def test_markdown_notes(spark, tmp_path):
    folder = tmp_path / "notas/fact"
    folder.mkdir(parents=True)
    (folder / "fact_7a3c1b2d.md").write_text("---\r\n" + DOCUMENT.replace("confidence: 0.7\n", "references: [fact_00000001]\n") + "---\nthe body\n")
    (folder / "bad.md").write_text("---\nid: x\n")
    (folder / "worse.md").write_text("---\na: 1\na: 2\n---\n")
    notes, warnings = store.read_notes(spark, str(tmp_path))
    n = notes.first()
    assert (notes.count(), warnings.count()) == (1, 2)
    assert n.id == "fact_7a3c1b2d" and n.body == "the body\n" and n.created_ms == 1767323045678 and n.tags == ["busca", "sem-vector-db"]
    assert [(e.kind, e.to) for e in n.edges] == [("references", "fact_00000001")]
    e = store.with_evidence(notes).first()
    assert (e.successes, e.failures, e.reviews) == (1.0, 0.0, 1)
    assert store.detached(notes, spark.createDataFrame([("fact_00000001",)], "id string")).first().edges == []


def test_event_log(spark, tmp_path):
    line = lambda **x: json.dumps(x) + "\n"
    (tmp_path / "events-0002.jsonl").write_text(line(id="b", op="write", note_id="n", at=2, data={}) + "{broken\n")
    (tmp_path / "events-0001.jsonl").write_text(line(id="a", op="write", note_id="n", at=1, data={}) + line(id="b", op="first", note_id="n", at=1, data={"k": "v"}))
    (tmp_path / "events.jsonl").write_text(line(id="c", op="task", note_id="n", at=86_400_001, data={"action": "review"}) + line(id="a", op="late", note_id="n", at=9, data={}))
    found, bad = logs.read_events(spark, str(tmp_path))
    assert {r.id: r.op for r in found.collect()} == {"a": "write", "b": "first", "c": "task"} and bad.count() == 1
    assert [r.id for r in logs.since(found, "b").collect()] == ["c"]
    assert logs.since(found, "gone").count() == 3
    named = logs.with_event_ids(found)
    assert named.where("id rlike '^evt_[0-9a-z]{8}$'").count() == 3
    logs.append_events(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    q = events.run_throughput(spark, str(tmp_path / "*.jsonl"), "flowing", str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [(r.start_ms, r.closed) for r in spark.table("flowing").collect()] == [(86_400_000, 1)]


def test_shards(spark, tmp_path):
    note = lambda i, at, agent, s: json.dumps({"frontmatter": {"id": i, "statement": s, "created_at": at, "provenance": {"agent_id": agent}}, "body": s}) + "\n"
    (tmp_path / "a.jsonl").write_text(note("fact_1", "2026-01-01T00:00:00Z", "a", "old") + note("fact_1", "2026-01-02T00:00:00Z", "a", "new") + "nonsense\n")
    (tmp_path / "b.jsonl").write_text(note("fact_1", "2026-01-02T00:00:00Z", "b", "other") + note("fact_2", "2026-01-01T00:00:00Z", "b", "two"))
    found, bad = logs.read_shards(spark, str(tmp_path))
    assert {r.id: (r.statement, r.agent_id) for r in found.collect()} == {"fact_1": ("other", "b"), "fact_2": ("two", "b")} and bad.count() == 1


def test_shard_names(spark):
    rows = spark.createDataFrame([("plain-1",), ("a/b c",), ("x" * 60,)], "a string").select(logs.shard_file_name(F.col("a")).alias("n")).collect()
    assert rows[0].n == "plain-1.jsonl" and rows[1].n.startswith("a_b_c-") and len(rows[2].n) == 48 + 9 + 6


def test_tables_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    assert store.load_table(spark, path, "retrieval-v5") is None
    store.save_table(spark.range(3), path, "retrieval-v5")
    assert store.load_table(spark, path, "retrieval-v5").count() == 3 and store.load_table(spark, path, "retrieval-v6") is None
    store.rebuild(spark.range(5), path + "2")
    store.rebuild(spark.range(7), path + "2")
    assert spark.read.parquet(path + "2").count() == 7


def test_cache(spark):
    cache = spark.createDataFrame([("h", "m", [1.0], 10), ("h", "m", [2.0], 10), ("h", "m", [9.0], 1), ("g", "m", [1.0], 0)], "body_hash string, cache_key string, vector array<float>, created_ms long")
    wanted = spark.createDataFrame([("h", "m"), ("g", "m"), ("x", "m")], "body_hash string, cache_key string")
    assert {r.body_hash: r.vector for r in store.cache_lookup(wanted, cache, 15, 10).collect()} == {"h": [2.0], "g": None, "x": None}


def test_project_paths(spark, tmp_path):
    for p in ("src/a.rs", "src/.env", ".git/config", "target/x", "docs/b.md"):
        f = tmp_path / "proj" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    assert {r.path for r in store.project_paths(spark, str(tmp_path / "proj")).collect()} <= {"src/a.rs", "docs/b.md", "target/x", ".git/config"} - {"target/x", ".git/config"}


def test_drain(spark, tmp_path):
    notes = spark.createDataFrame([("a", "s", "b", "h1"), ("c", "s2", "", "h2")], "id string, statement string, body string, body_hash string")
    index = spark.createDataFrame([("a", "old")], "id string, body_hash string")
    waiting = drain.pending(notes, index)
    assert {(r.id, r.state) for r in waiting.collect()} == {("a", "stale"), ("c", "pending")}
    assert drain.backpressure(waiting, 1) and not drain.backpressure(waiting, 2)
    notes.write.parquet(str(tmp_path / "in"))
    q = drain.start(spark, str(tmp_path / "in"), notes.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), str(tmp_path / "out"), str(tmp_path / "c"), lambda: embedder(16))
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
