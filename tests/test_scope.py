"""What a report is about, hierarchies, and where notes come from."""

import json

import pytest

from lorewell.operators import graph, semantic
from lorewell.operators.filters import Filter
from lorewell.operators.scope import Scope, scoped
from lorewell.sources.store import read_source
from tests.test_operators import corpus, note


def ids(c):
    return {r.id for r in c.notes.collect()}


def test_reports_want_a_scope(spark):
    c = corpus(spark, [note("a", tags=["x"]), note("b"), note("c", status="forgotten", tags=["x"]), note("d")], [("a", "references", "b"), ("b", "references", "c"), ("c", "references", "d"), ("d", "references", "a")])
    for bad in (Scope(), Scope(Filter(statuses=("forgotten",)))):
        with pytest.raises(ValueError, match="rank"):
            scoped(c, bad, "rank")
    assert ids(scoped(c, Scope(universe=True), "rank")) == {"a", "b", "d"}
    assert ids(scoped(c, Scope(Filter(tags=("x",))), "rank")) == {"a"}
    assert ids(scoped(c, Scope(around="a", depth=1), "rank")) == {"a", "b"}
    assert ids(scoped(c, Scope(around="a", depth=3), "rank")) == {"a", "b", "d"}
    with pytest.raises(KeyError):
        scoped(c, Scope(around="none"), "rank")


def test_narrower_is_broader_the_other_way(spark):
    edges = spark.createDataFrame([("a", "broader", "b"), ("c", "narrower", "b"), ("c", "broader", "d"), ("x", "broader", "y"), ("x", "narrower", "y"), ("s", "narrower", "s")], "src string, kind string, dst string")
    rows = {(r.src, r.dst) for r in graph.hierarchy(edges, spark.createDataFrame([("a",), ("c",)], "id string")).collect()}
    assert rows == {("a", "b"), ("a", "c"), ("a", "d"), ("c", "d")}
    assert {(r.id, r.component) for r in graph.hierarchy_cycles(edges).collect()} == {("x", "x"), ("y", "x"), ("s", "s")}


def test_suggested_links_have_none_in_either_direction(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.2]), ("d", [0.0, 1.0])], "id string, vector array<double>")
    edges = spark.createDataFrame([("b", "related", "a")], "src string, kind string, dst string")
    assert {(r.src, r.dst) for r in semantic.link_suggestions(v, edges, v, 0, 0.9).collect()} == {("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")}


def test_a_source_is_told_by_what_is_there(spark, tmp_path):
    line = lambda i: json.dumps({"frontmatter": {"id": i, "statement": i}, "body": "x"})
    shards, folder = tmp_path / "shards", tmp_path / "notes"
    shards.mkdir(), folder.mkdir()
    (shards / "one.jsonl").write_text(line("a") + "\n" + line("b") + "\n")
    (shards / "two.jsonl").write_text(line("c") + "\n")
    (shards / "note.txt").write_text("no shard")
    (folder / "n.md").write_text("---\nid: n\nstatement: kept\n---\nbody")
    read = lambda p: {r.id for r in read_source(spark, str(p))[0].collect()}
    assert read(shards) == {"a", "b", "c"} and read(shards / "two.jsonl") == {"c"} and read(folder) == {"n"}
    with pytest.raises(ValueError):
        read_source(spark, str(shards / "note.txt"))
    with pytest.raises(FileNotFoundError):
        read_source(spark, str(tmp_path / "none"))
