"""Shrinking with large sets of deleted nodes that reach each other."""

import random

from lodestone.operators import graph as g
from lodestone.operators.closure import circles


def _reached(edges, start):
    seen, todo = set(), list(start)
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_shrink_passes_rings_as_one_node(spark, monkeypatch):
    rng = random.Random(3)
    edges = {(a, rng.randrange(60)) for a in range(60) for _ in range(3)} | {(60, 61), (61, 62), (62, 60), (0, 60), (62, 1), (40, 41)}
    deleted = set(range(10, 40)) | {60, 61, 62}
    calls = []
    monkeypatch.setattr(g, "PAIRS", 0)
    monkeypatch.setattr(g, "circles", lambda inner: calls.append(1) or circles(inner))
    graph = g.Graph.build(spark.createDataFrame([(10,), (45,), (60,)], "node long"), spark.createDataFrame(sorted(edges), "src long, dst long")).saved()
    out = graph.shrink(spark.createDataFrame([(n,) for n in deleted], "node long"))
    assert calls
    inner = {}
    for a, b in edges:
        if a in deleted:
            inner.setdefault(a, set()).add(b)
    expected, nodes = set(), {n for e in edges for n in e}
    for a, b in edges:
        if a not in deleted:
            expected |= {(a, c) for c in ({b} | (_reached(inner, [b]) if b in deleted else set())) - deleted}
    assert {tuple(r) for r in out.edges.collect()} == expected
    direct = {45} | (_reached(inner, [10, 60]) - deleted)
    assert {tuple(r) for r in out.vertices.collect()} == {(n, n in direct) for n in nodes - deleted}
