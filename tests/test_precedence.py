"""Order and circles over two relations against plain walks, chains of 100,000 and forks that close again."""

import random

import pytest

from loomline.operators import precedence


def closure(n, edges):
    reach = {v: set() for v in range(n)}
    for v in range(n):
        todo = [b for a, b in edges if a == v]
        while todo:
            u = todo.pop()
            if u not in reach[v]:
                reach[v].add(u)
                todo += [b for a, b in edges if a == u]
    return reach


def plain(n, edges):
    reach = closure(n, edges)
    round_ = {v for v in range(n) if v in reach[v]}
    circle = {v: min(u for u in reach[v] if v in reach.get(u, ())) for v in round_}
    state = {v: "circle" if v in round_ or reach[v] & round_ else "absent" if any(u >= n for u in reach[v]) else "ready" for v in range(n)}
    wave = {}

    def depth(v):
        if v not in wave:
            wave[v] = max((depth(b) + 1 for a, b in edges if a == v), default=0)
        return wave[v]

    return circle, {v: (depth(v) if s == "ready" else None, s) for v, s in state.items()}


def frames(spark, n, edges):
    return spark.range(n), spark.createDataFrame(edges, "id long, needs long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_relations(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(v, rng.randrange(v)) for v in range(1, n) if rng.random() < 0.9] + [(v, rng.randrange(v)) for v in range(1, n) if rng.random() < 0.3]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(seed * 2)] + [(rng.randrange(n), n + 5)] * 2
    circle, order = plain(n, edges)
    nodes, e = frames(spark, n, [*edges, (n + 9, 1), (None, 2), (3, None)])
    assert {r.id: (r.wave, r.state) for r in precedence.ordered(nodes, e).collect()} == order
    assert {r.id: r.circle for r in precedence.circles(nodes, e).collect()} == circle


def test_two_circles_with_a_way_between_and_a_self_edge(spark):
    edges = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3), (5, 5), (6, 5), (7, 8)]
    nodes, e = frames(spark, 9, edges)
    assert {r.id: r.circle for r in precedence.circles(nodes, e).collect()} == {0: 0, 1: 0, 3: 3, 4: 3, 5: 5}
    assert {r.id: r.state for r in precedence.ordered(nodes, e).collect()} == {v: "ready" if v in (7, 8) else "circle" for v in range(9)}


def test_chains_of_a_hundred_thousand_with_edits(spark, monkeypatch):
    """Every third message has an edit beside it, which needs it and its parent: rounds follow the logarithm."""
    n, joins = 100_000, []
    monkeypatch.setattr(precedence, "cut", lambda df, real=precedence.cut: (joins.append(1), real(df))[1])
    parent = spark.range(1, n).selectExpr("id", "id - 1 - CAST(id % 3 = 0 AS LONG) AS needs")
    edit = spark.range(1, n).where("id % 3 = 2").selectExpr("id", "id - 1 AS needs")
    found = precedence.ordered(spark.range(n), parent.union(edit))
    assert found.where("state <> 'ready'").isEmpty() and found.count() == n
    assert found.agg({"wave": "max"}).first()[0] == plain_depth(n)
    assert len(joins) < 60


def plain_depth(n):
    wave = [0] * n
    for v in range(1, n):
        wave[v] = 1 + max(wave[v - 1 - (v % 3 == 0)], wave[v - 1] if v % 3 == 2 else 0)
    return max(wave)


def test_empty(spark):
    nodes, e = frames(spark, 0, [])
    assert precedence.ordered(nodes, e).isEmpty() and precedence.circles(nodes, e).isEmpty()


def test_a_known_order_is_not_made_again(spark, monkeypatch):
    """Trimming from below takes the order that is given; only the way back is ordered."""
    edges = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3), (5, 5), (6, 5), (7, 8)]
    nodes, e = frames(spark, 9, edges)
    order, runs = precedence.ordered(nodes, e), []
    monkeypatch.setattr(precedence, "ordered", lambda *a, real=precedence.ordered: (runs.append(1), real(*a))[1])
    assert {r.id: r.circle for r in precedence.circles(nodes, e, order).collect()} == {0: 0, 1: 0, 3: 3, 4: 3, 5: 5}
    known = len(runs)
    runs.clear()
    precedence.circles(nodes, e)
    assert known == len(runs) - 1


def test_many_small_relations_at_once(spark):
    """Three hundred graphs of at most 12 nodes side by side, sparse and dense, with absent needs, circles and self edges."""
    rng, edges, circle, order, size = random.Random(5), [], {}, {}, 12
    for k in range(300):
        own = {(v, rng.randrange(v)) for v in range(1, size) if rng.random() < 0.8} | {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(8))}
        own = {(b, a) for a, b in own} if k % 2 else own
        own |= {(rng.randrange(size), size + rng.randrange(3)) for _ in range(rng.randrange(3))}
        c, o = plain(size, sorted(own))
        circle |= {v + k * 20: u + k * 20 for v, u in c.items()}
        order |= {v + k * 20: x for v, x in o.items()}
        edges += [(a + k * 20, b + k * 20) for a, b in own]
    nodes, e = spark.createDataFrame([(v,) for v in order], "id long"), spark.createDataFrame(edges, "id long, needs long")
    assert {r.id: (r.wave, r.state) for r in precedence.ordered(nodes, e).collect()} == order
    assert {r.id: r.circle for r in precedence.circles(nodes, e).collect()} == circle


def test_a_branch_at_every_fifth_node_takes_no_round_of_its_own(spark, monkeypatch):
    """Seen from the roots, a long thread with branches: a node needs its children, of which one is a leaf."""
    n, joins = 201, []
    monkeypatch.setattr(precedence, "cut", lambda df, real=precedence.cut: (joins.append(1), real(df))[1])
    edges = [(v - (2 if v % 5 == 4 else 1), v) for v in range(1, n)]
    nodes, e = frames(spark, n, edges)
    wave = {}
    for v in reversed(range(n)):
        wave[v] = max((wave[b] + 1 for a, b in edges if a == v), default=0)
    assert {r.id: r.wave for r in precedence.ordered(nodes, e).collect()} == wave
    assert len(joins) < 40


def test_rounds_and_sizes_stay_small_beside_a_circle(spark, monkeypatch):
    """Rounds follow the longest chain, not the number of nodes; the planner's sizes do not multiply over them."""
    n, sizes = 20_000, []

    def noted(df, real=precedence.cut):
        found = real(df)
        sizes.append(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return found

    monkeypatch.setattr(precedence, "cut", noted)
    edges = spark.range(n).where("id % 50 > 0").selectExpr("id", "id - 1 AS needs").union(spark.createDataFrame([(0, 7)], "id long, needs long"))
    found = precedence.ordered(spark.range(n), edges)
    assert {r.state: r["count"] for r in found.groupBy("state").count().collect()} == {"ready": n - 50, "circle": 50}
    assert found.where("state = 'ready' AND wave <> id % 50").isEmpty()
    assert len(sizes) < 20 and max(sizes) < 2**40
