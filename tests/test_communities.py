"""Communities against the best partition of small graphs, and by their modularity on larger ones."""

import random
from itertools import combinations

import pytest

from lorewell.operators import communities

GRAPH = "a long, b long, w double"


def quality(edges, of):
    mass = 2 * sum(w for _, _, w in edges)
    degree, inner = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            degree[x] = degree.get(x, 0) + w
        inner += 2 * w * (of[a] == of[b])
    total = {}
    for x, d in degree.items():
        total[of[x]] = total.get(of[x], 0) + d
    return inner / mass - sum((t / mass) ** 2 for t in total.values())


def every_partition(nodes):
    """All partitions of a few nodes, as dicts of node to part."""
    if not nodes:
        yield {}
        return
    for rest in every_partition(nodes[1:]):
        parts = max(rest.values(), default=-1) + 1
        for p in range(parts + 1):
            yield {nodes[0]: p, **rest}


def found(spark, edges):
    out = {r.u: r.label for r in communities.partition(spark.createDataFrame(edges, GRAPH)).collect()}
    assert set(out) == {x for a, b, _ in edges for x in (a, b)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_close_to_the_best_partition(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, float(rng.randint(1, 3))) for a, b in combinations(range(8), 2) if rng.random() < 0.4]
    best = max(quality(edges, p) for p in every_partition(sorted({x for e in edges for x in e[:2]})))
    assert quality(edges, found(spark, edges)) >= best - 0.03


def test_ring_of_cliques(spark):
    edges = [(8 * c + i, 8 * c + j, 1.0) for c in range(12) for i, j in combinations(range(8), 2)] + [(8 * c, 8 * ((c + 1) % 12) + 1, 1.0) for c in range(12)]
    of = found(spark, edges)
    assert len(set(of.values())) == 12 and all(of[8 * c + i] == of[8 * c] for c in range(12) for i in range(8))
    assert of == found(spark, edges[::-1])


def test_planted_parts_and_a_hub(spark):
    rng = random.Random(9)
    planted = {x: x % 6 for x in range(240)}
    edges = [(a, b, 1.0) for a, b in combinations(range(240), 2) if rng.random() < (0.3 if planted[a] == planted[b] else 0.01)]
    edges += [(240, x, 1.0) for x in range(240)]  # one node linked with all
    of = found(spark, edges)
    assert quality(edges, of) >= quality(edges, {**planted, 240: 0}) - 1e-9


def test_loops_pairs_and_nothing(spark):
    assert found(spark, [(1, 1, 1.0), (2, 3, 1.0)]) in ({1: 1, 2: 2, 3: 2}, {1: 1, 2: 3, 3: 3})
    assert communities.partition(spark.createDataFrame([], GRAPH)).collect() == []


def test_modularity_of_the_tables(spark, sf):
    """Better than single notes and than components, and what the module says it is."""
    from lorewell.operators.semantic import weighted_graph
    from lorewell.sources import bound

    c = bound.corpus(spark, sf)
    rows = [(r.a, r.b, r.w) for r in weighted_graph(c).collect()]
    of = {r.id: r.community for r in communities.found(c).collect()}
    assert len(of) == c.notes.count() and all(of[x] <= x for x in of)
    number = {x: i for i, x in enumerate(sorted(of))}
    graph = spark.createDataFrame([(number[a], number[b], w) for a, b, w in rows], GRAPH)
    labels = spark.createDataFrame([(number[x], number[y]) for x, y in of.items()], "u long, label long")
    q = quality(rows, of)
    assert abs(communities.modularity(communities._both_ways(graph), labels) - q) < 1e-9
    assert q > 0.3 and q > quality(rows, {x: 0 for x in of})
