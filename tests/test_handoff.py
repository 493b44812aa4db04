"""Hand-offs by value: nothing is capped but by the budget, bodies come along, and what was given out can be resumed."""

import pytest

from lorewell.operators import handoff
from tests.test_operators import corpus, note


def lines(df):
    return [(r.line, r.truncated, r.dropped) for r in df.orderBy("position").collect()]


def test_every_line_that_fits_the_budget(spark):
    notes = [note("root", kind="epic", scope="epic"), *[note(f"n{i:04}", "x" * 30, at=i) for i in range(1200)]]
    c = corpus(spark, notes, [("root", "results_in", f"n{i:04}") for i in range(1200)])
    out = lines(handoff.rewind(c, "scope", "root", budget=20_000))
    assert len(out) == 1201 and out[-1][1:] == (False, 0)
    out = lines(handoff.rewind(c, "scope", "root", budget=7_005))  # 45 letters are 12 tokens each
    assert len(out) == 583 and {x[1:] for x in out} == {(False, 1201 - 583)}


def test_bodies_of_foundations_and_decisions(spark):
    notes = [note("e", kind="epic", scope="epic"), note("f", "base", "  one\ntwo \n", cls="foundational"), note("d", "chosen", "why", kind="decision"), note("t", "plain", "hidden"), note("b", "blank", " \n ", cls="foundational")]
    c = corpus(spark, notes, [("e", "results_in", i) for i in "fdtb"])
    out = [x[0] for x in lines(handoff.rewind(c, "scope", "e"))]
    assert sorted(out) == sorted(["b|blank|foundational", "f|base|foundational\none\ntwo", "d|chosen|tactical\nwhy", "e||tactical", "t|plain|tactical"])
    cut = lines(handoff.rewind(corpus(spark, [note("f", "s", "y" * 4000, cls="foundational"), note("e", kind="epic", scope="epic")], [("e", "results_in", "f")]), "scope", "e", budget=200))
    assert len(cut) == 1 and len(cut[0][0]) == 801 and cut[0][0].endswith("…") and cut[0][1:] == (True, 2)


def test_files_bring_the_members_of_their_programs(spark):
    notes = [note("p", kind="epic", scope="epic", anchors=["plan/*.md"]), note("in", "member"), note("dep", "dependent"), note("at", "anchored", anchors=["plan/a.md"]), note("out", "elsewhere", anchors=["src/x"])]
    c = corpus(spark, notes, [("p", "results_in", "in"), ("dep", "depends_on", "p")])
    assert {x[0].split("|")[0] for x in lines(handoff.rewind(c, "files", paths=("plan/a.md",)))} == {"p", "in", "dep", "at"}
    assert lines(handoff.rewind(c, "files", paths=("none",))) == []


def test_manifest_text(spark):
    c = corpus(spark, [note("a", "first", kind="task", scope="task", at=1), note("b", "second", kind="task", scope="task", at=2)], [("b", "depends_on", "a")])
    out = lines(handoff.rewind(c, "manifest", budget=100))
    assert [x[0] for x in out[:3]] == ["notes=2 ready=1 blocked=1 containers=0 clean", "recent: b a", "next: a|first"] and out[3][0].startswith("fresh: stale=") and out[0][1:] == (False, 0)


def test_contexts_are_resumed_by_what_they_say(spark, tmp_path):
    kept = handoff.Contexts(spark, str(tmp_path / "contexts"))
    one = spark.createDataFrame([(0, "a|b"), (1, "c\nd")], "position long, line string")
    name = kept.save(one)
    assert kept.save(one) == name and kept.save(one.limit(1)) != name
    assert sorted(tuple(r) for r in handoff.Contexts(spark, str(tmp_path / "contexts")).resume(name).collect()) == [(0, "a|b"), (1, "c\nd")]
    with pytest.raises(ValueError):
        kept.resume("ctx_../x")
    with pytest.raises(KeyError):
        kept.resume("ctx_00000000")
