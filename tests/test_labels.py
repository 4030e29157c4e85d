"""Interval labels against plain walks, on long chains, wide stars and broken input."""

import random

import pytest

from loomline.operators import graph


def walks(parent):
    above = {}
    for v in parent:
        seen, at = [], parent[v]
        while at in parent and at not in seen and at != v:
            seen.append(at)
            at = parent[at]
        above[v] = None if at == v or at in seen else seen
    return above


@pytest.mark.parametrize("siblings", [graph.SIBLINGS, 3])
def test_labels_of_a_random_forest(spark, monkeypatch, siblings):
    monkeypatch.setattr(graph, "SIBLINGS", siblings)
    rng = random.Random(1)
    parent = {i: None if rng.random() < 0.05 else rng.choice([0, rng.randrange(i)]) if i else None for i in range(400)}
    parent |= {1000: 9999, 1001: 1000, 2000: 2001, 2001: 2000, 2002: 2001, 3000: 3000}  # a missing parent, a cycle and below it, its own parent
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    above = walks(parent)
    found = {r.id: r for r in graph.labels(nodes).collect()}
    assert set(found) == {v for v, a in above.items() if a is not None}
    assert {v: r.below for v, r in found.items()} == {v: sum(v in (a or ()) for a in above.values()) for v in found}
    assert all(r.root == (above[v] or [v])[-1] for v, r in found.items())
    pairs = [(a, b) for a in rng.sample(sorted(parent), 60) for b in rng.sample(sorted(parent), 30)] + [(5, 424242)]
    holds = graph.is_ancestor(spark.createDataFrame(pairs, "ancestor long, id long"), nodes)
    assert sorted((r.ancestor, r.id, r.holds) for r in holds.collect()) == sorted((a, b, a in (above.get(b) or ())) for a, b in pairs)


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("id", "IF(id > 0, id - 1, NULL) AS parent_id")
    found = graph.labels(nodes)
    assert found.where(f"below <> {n} - 1 - id OR root <> 0").isEmpty() and found.count() == n
