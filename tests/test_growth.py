"""Steps whose work grew faster than their input, against plain ways."""

import random

import numpy as np
from pyspark.sql import functions as F

from lorewell.functions import text
from lorewell.functions.ids import TYPES
from lorewell.operators import communities, semantic
from lorewell.sources import bound


def test_similar_pairs_meet_once_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 7)
    monkeypatch.setattr(semantic, "PAIR_ROWS", 3)
    m = np.random.default_rng(3).normal(size=(40, 4))
    m[5], m[9] = m[4], 0
    names = [f"v{i:02}" for i in range(40)]
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(names, m)], "id string, vector array<float>")
    u = np.array(v.orderBy("id").toPandas()["vector"].tolist(), np.float64)
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=np.zeros_like(u), where=np.linalg.norm(u, axis=1, keepdims=True) > 0)
    s = np.round(u @ u.T, 6)
    got = [(r.a, r.b) for r in semantic.similar_pairs(v, 0.3).collect()]
    assert sorted(got) == [(names[i], names[j]) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.3]


def test_mentions_cut_a_text_once(spark):
    """F16: the plan cuts the text at one place, however many cues and ids there are."""
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choice(["depende de", "fact_0000000" + str(rnd.randrange(9)), "veja [[", "def_00000001", "confirma "]) for _ in range(rnd.randrange(9))),) for _ in range(30)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "body string")
    out = df.select("body", text.mentions("body", TYPES).alias("m"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    for r in out.collect():
        assert len(r.m) == sum(w[:5] in ("fact_", "def_0") for w in (r.body or "").replace("[[", "[[ ").split())
    r = df.limit(1).select(text.mentions(F.lit("isto requer fact_00000001, [[def_00000002 e substitui fact_00000003"), TYPES).alias("m")).first()
    assert [tuple(x) for x in r.m] == [("fact_00000001", "depends_on", "verbo"), ("def_00000002", "references", "wikilink"), ("fact_00000003", "replaces", "verbo")]


def test_communities_send_no_nodes_through_the_driver(spark, sf, monkeypatch):
    """no step broadcasts; what is written, the graph and the result, joins by sorting alone. Only the numbers of ranges (_part) are few."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    write = communities.written
    monkeypatch.setattr(communities, "written", lambda df: plans.append(plan(df)) or write(df))
    plans.append(plan(communities.found(bound.corpus(spark, sf))))
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 9 and all("SortMergeJoin" in p for p in joins if "_part" not in p)
    assert not [p for p in plans if "Broadcast" in p and "_part" not in p]
