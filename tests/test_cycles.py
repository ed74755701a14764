"""Strongly connected components against brute force; long chains in few rounds."""

from __future__ import annotations

import random

import pytest

from quillgraph.operators import graph


def brute(edges):
    """Node to the set of nodes of its component, for nodes on cycles."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(start):
        seen, work = set(), [start]
        while work:
            for y in out.get(work.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    work.append(y)
        return seen

    reached = {x: reach(x) for x in {n for e in edges for n in e}}
    return {x: frozenset(y for y in r if x in reached[y]) for x, r in reached.items() if x in r}


def found(spark, edges):
    rows = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == len({r.id for r in rows})
    groups = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.id)
    return {x: frozenset(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(40), draw.randrange(40)) for _ in range(30 + 15 * seed)]
    for k in range(3):  # rings, alone or joined, and chains between nodes
        nodes = [100 * (k + 1) + x for x in range(draw.randint(1, 6))]
        edges += list(zip(nodes, nodes[1:] + nodes[:1], strict=True))
        way = [draw.randrange(40), *[1000 * (k + 1) + x for x in range(draw.randint(1, 9))], draw.randrange(40)]
        edges += list(zip(way, way[1:], strict=False))
        if k == 2:
            edges.append((nodes[0], draw.randrange(40)))
    assert found(spark, edges) == brute(edges)


def test_nothing(spark):
    assert found(spark, []) == {} and found(spark, [(1, 2), (2, 3)]) == {} and found(spark, [(7, 7)]) == {7: frozenset([7])}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Ten thousand nodes in a row, a ring of seventy at the end, a chain from the ring, chains between rings."""
    tables = []
    plain = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: (tables.append(name), plain(df, name))[1])
    edges = [(k, k + 1) for k in range(10_000)]
    ring = [10_000 + k for k in range(70)]
    edges += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(10_050, 20_000)] + [(20_000 + k, 20_001 + k) for k in range(3000)]
    assert found(spark, edges) == {x: frozenset(ring) for x in ring}
    assert len(tables) < 40


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks(spark, seed):
    """Blocks of nine edges, so that most cycles lie across blocks; ids near each other and dealt at random."""
    draw = random.Random(10 + seed)
    edges = [(k, k + draw.choice((-2, -1, 1, 3))) for k in range(60) for _ in range(1 + (draw.random() < 0.3))] + [(draw.randrange(60), draw.randrange(60)) for _ in range(8 * seed)]
    rows = graph.components(spark.createDataFrame(edges, "src long, dst long"), 9).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.id)
    assert len(rows) == len({r.id for r in rows})
    assert {x: frozenset(g) for g in groups.values() for x in g} == brute(edges)


def test_a_row_of_rings_takes_few_rounds(spark, monkeypatch):
    """Three hundred rings, each joined to the next: rounds don't grow with their number."""
    tables = []
    plain = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: (tables.append(name), plain(df, name))[1])
    edges = [(10 * k + x, 10 * k + (x + 1) % 4) for k in range(300) for x in range(4)] + [(10 * k, 10 * k + 10) for k in range(299)]
    rows = graph.components(spark.createDataFrame(edges, "src long, dst long"), 400).collect()
    assert {r.id for r in rows} == {a for a, _ in edges} and len({r.component for r in rows}) == 300 and len(tables) < 60
