"""Persisted state: manifests, indexes, caches and logs, by value and across failures."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lorewell.functions.runtime import running
from lorewell.operators import retrieval
from lorewell.sources import cache, logs
from lorewell.sources.indexes import TermIndex, VectorTable
from lorewell.sources.versions import Conflict, Versions, commit_together

NOTE = "id string, type string, statement string, body string, tags array<string>, successes double"
EVENT = "id string, op string, note_id string, at long, data map<string,string>"


def notes(spark, **texts):
    return spark.createDataFrame([(i, "fact", t, f"body of {t}", ["en"], 0.0) for i, t in texts.items()], NOTE)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    got = {r.i: (r.position, r.before) for r in running(spark.createDataFrame(rows, "i long, k long, v long"), "v", "k", F.desc("i")).collect()}
    total = 0
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], -r[0]))):
        assert got[i] == (place, total)
        total += v


def test_a_killed_commit_changes_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    note, event = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("e1", "a")], "id string, note_id string")
    read = lambda: [sorted(r.id for r in v.read(v.current()[1], t, "id string").collect()) for t in ("notes", "events")]
    commit_together(v, note, event)
    broken = spark.createDataFrame([("e2", "b")], "id string, note_id string").withColumn("bad", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        commit_together(v, spark.createDataFrame([("b",)], "id string"), broken)  # notes are written, events fail
    assert read() == [["a"], ["e1"]] and v.current()[0] == 1
    commit_together(v, spark.createDataFrame([("b",)], "id string"), spark.createDataFrame([("e2", "b")], "id string, note_id string"))
    assert read() == [["a", "b"], ["e1", "e2"]]
    assert v.sweep(1) == 2 and read() == [["a", "b"], ["e1", "e2"]]  # what the killed commit left of two parts


def test_two_writers_and_a_torn_manifest(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    seen, manifest = v.current()
    v.commit(seen, manifest | {"who": "one"})
    with pytest.raises(Conflict):
        v.commit(seen, manifest | {"who": "two"})
    (tmp_path / "store" / "_versions" / "00000002.json").write_text('{"tables": {"x"')
    assert v.current() == (1, {"tables": {}, "who": "one"})
    assert v.commit(1, manifest | {"who": "three"}) == 3 and v.current()[1]["who"] == "three"


def ranking(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def test_index_follows_its_notes(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "terms"), buckets=3, segments=4)
    same = lambda n: ranking(index.bm25(n, "kernel panic")) == ranking(retrieval.bm25(n, "kernel panic"))
    n = notes(spark, a="kernel panic", b="kernel", c="other")
    assert index.bm25(n, "kernel").count() == 0
    assert index.refresh(n) == "rebuilt" and same(n) and index.refresh(n) == "fresh"
    n = notes(spark, a="kernel", b="quiet", d="panic panic kernel", e="")
    assert {(r.id, r.change) for r in index.stale(n).collect()} == {("a", "changed"), ("b", "changed"), ("c", "removed"), ("d", "new"), ("e", "new")}
    assert index.refresh(n) == "updated" and same(n)
    index.compact()
    assert same(n) and index.refresh(n) == "fresh" and len(index.versions.current()[1]["tables"]["docs"]) == 1
    for k in range(5):  # the fifth segment brings compaction
        n = notes(spark, a=f"kernel {'panic ' * k}", d="panic")
        assert index.refresh(n) == "updated" and same(n)
    assert len(index.versions.current()[1]["tables"]["docs"]) < 5


def test_a_foreign_header_rebuilds(spark, tmp_path):
    n = notes(spark, a="kernel panic", b="kernel")
    TermIndex(spark, str(tmp_path / "terms"), buckets=3).refresh(n)
    other = TermIndex(spark, str(tmp_path / "terms"), buckets=5)
    assert other.bm25(n, "kernel").count() == 0 and other.refresh(n) == "rebuilt" and other.refresh(n) == "fresh"
    assert ranking(other.bm25(n, "kernel")) == ranking(retrieval.bm25(n, "kernel"))


def test_vectors_of_another_model_are_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1", [1.0, 2.0]), ("b", "h1", [1.0])], "id string, body_hash string, vector array<double>")
    table = VectorTable(spark, str(tmp_path / "v"), "m1", 2)
    table.add(rows)
    table.add(spark.createDataFrame([("a", "h2", [3.0, 4.0])], rows.schema))
    assert [(r.id, r.body_hash, r.vector) for r in table.load().collect()] == [("a", "h2", [3.0, 4.0])]
    for model, size in (("m2", 2), ("m1", 3)):
        assert VectorTable(spark, str(tmp_path / "v"), model, size).load().count() == 0


def entry(key, made, used, vector=(1.0, 2.0)):
    return (key, "m", list(vector), made, used)


ENTRY = "body_hash string, model string, vector array<double>, created_ms long, used_ms long"


def test_eviction_against_a_cache_that_is_used_in_order(spark):
    rng = random.Random(3)
    for limit in (0, 9, 40, 100, 10_000):
        held, rows = OrderedDict(), []
        for t, k in enumerate(rng.sample(range(100), 30)):
            vector = [float(x) for x in range(rng.randint(1, 6))]
            rows.append(entry(f"k{k:03}", 0, t, vector))
            size = len(vector) * 4 + 1
            if size <= limit:
                while sum(held.values()) + size > limit:
                    held.popitem(last=False)
                held[f"k{k:03}"] = size
        df = spark.createDataFrame(rows, ENTRY)
        got = {r.body_hash for r in cache.fitting(cache.merged(df.limit(0), df, limit), limit).collect()}
        assert got == set(held), limit


def test_conflicts_age_and_use(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), ENTRY)
    old, new = df(entry("a", 5, 1, [1.0, 9.0]), entry("b", 5, 1), entry("c", 5, 1, [2.0])), df(entry("a", 4, 8, [7.0]), entry("b", 6, 2, [0.0]), entry("c", 5, 3, [2.0, 0.0]), entry("d", 1, 1))
    out = {r.body_hash: (r.vector, r.created_ms, r.used_ms) for r in cache.merged(old, new).collect()}
    assert out == {"a": ([1.0, 9.0], 5, 8), "b": ([0.0], 6, 2), "c": ([2.0, 0.0], 5, 3), "d": ([1.0, 2.0], 1, 1)}
    assert {r.body_hash for r in cache.unexpired(cache.merged(old, new), 7, 2).collect()} == {"a", "b", "c"}
    assert cache.unexpired(new, 10**9, 0).count() == 4
    wanted = spark.createDataFrame([("b", "m"), ("b", "m"), ("x", "m")], "body_hash string, model string")
    assert {r.body_hash: r.used_ms for r in cache.used(old, wanted, 77).collect()} == {"a": 1, "b": 77, "c": 1}


def test_log_is_cut_by_bytes(spark, tmp_path):
    rows = [(f"e{i:03}", "write", "n" * (i % 7), i // 3, {"k": "v" * (i % 11)}) for i in range(120)]
    v = Versions(spark, str(tmp_path / "log"))
    for a in range(0, 120, 40):
        logs.append_rotated(v, spark.createDataFrame(rows[a : a + 40], EVENT), 500)
    got = {r.id: r for r in logs.rotated(v).collect()}
    at = 0
    for i, op, n, t, data in rows:
        size = len('{"at":%d,"data":{"k":"%s"},"id":"%s","note_id":"%s","op":"%s"}' % (t, data["k"], i, n, op)) + 1
        assert (got[i].bytes, got[i].segment) == (size, at // 500)
        at += size
    assert v.current()[1]["bytes"] == at


def test_recall_of_the_vector_index(spark):
    """Clustered vectors, a cell with a third of all, and every 50th as a query."""
    import numpy as np

    from lorewell.operators import semantic

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    of = np.where(rng.random(6000) < 1 / 3, 0, rng.integers(0, 30, 6000))
    rows = [(f"n{i:05}", (centres[c] + rng.normal(size=24) * 0.5).tolist()) for i, c in enumerate(of)] + [("n99999", [0.0] * 24)]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = v.where("cast(substr(id, 2) as int) % 50 = 0")
    exact = {(r.origin, r.id) for r in semantic.neighbours(v, asked, 10, 0.0).collect()}
    m = np.array([x for _, x in rows])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    brute = set()
    for i in range(0, 6000, 50):
        s = np.round(unit @ unit[i], 6)
        best = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != i and s[j] >= 0)[:10]
        brute |= {(rows[i][0], y) for _, y in best}
    assert exact == brute
    index = semantic.VectorIndex(v, cells=32)
    found = {(r.origin, r.id) for r in index.search(asked, 10, 0.0).collect()}
    assert len(found & exact) / len(exact) >= 0.95
    near = {(r.origin, r.id) for r in semantic.neighbours(v, asked, 0, 0.8).collect()}
    assert len(near) > 100 and len({(r.origin, r.id) for r in index.search(asked, 0, 0.8).collect()} & near) / len(near) >= 0.95


def test_blocks_of_one_cell_meet(spark, monkeypatch):
    from lorewell.operators import semantic

    monkeypatch.setattr(semantic, "BLOCK", 7)
    rng = random.Random(4)
    v = spark.createDataFrame([(f"n{i:02}", [rng.random() for _ in range(3)]) for i in range(40)], "id string, vector array<double>")
    pairs = semantic.similar_pairs(v, -1.0).collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) == 40 * 39 // 2
    assert semantic.neighbours(v, v.limit(0), 3, 0.0).collect() == [] and semantic.neighbours(v, v, 3, -1.0).count() == 120
