import random

import pytest

from meshweave import Graph
from meshweave.operators import graph as graph_module
from meshweave.operators import spread, waves


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pieces(seed, deep):
    """Random multigraphs side by side, with loops and parallel edges, and a long cycle with a chord; edge order is mixed."""
    rng, pairs, base = random.Random(seed), [], 0
    for _ in range(60):
        n = rng.randint(1, 8)
        pairs += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(0, 12))]
        base += n
    pairs += [(base + k, base + (k + 1) % deep) for k in range(deep)] + [(base, base + deep // 2), (base + 1, base + deep)]
    rng.shuffle(pairs)
    return range(base + deep + 1), pairs


@pytest.mark.parametrize("what", ["bridges", "blocks", "cycle_basis"])
def test_large_components(spark, monkeypatch, what):
    g = Graph.from_lists(spark, *pieces(3, 9))
    want = rows(getattr(g, what)())
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    monkeypatch.setattr(graph_module, "COMPONENT_EDGES", 5)
    assert rows(getattr(g, what)()) == want


def test_large_strong_components(spark, monkeypatch):
    g = Graph.from_lists(spark, *pieces(4, 6), directed=True)
    want = rows(g.strongly_connected_components())
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    monkeypatch.setattr(graph_module, "COMPONENT_EDGES", 5)
    assert rows(g.strongly_connected_components()) == want


@pytest.mark.parametrize("small", [500_000, 2])
def test_breadth_first_ranks(spark, monkeypatch, small):
    nodes, pairs = pieces(6, 7)
    g = Graph.from_lists(spark, nodes, pairs)
    source = len(nodes) - 1
    want = rows(g.bfs(source))
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    monkeypatch.setattr(waves, "SMALL_WAVE", small)
    monkeypatch.setattr(waves, "buckets", lambda rows: 3)
    assert rows(g.bfs(source)) == want


def test_cycles_of_deep_and_shallow_forests(spark, monkeypatch):
    g = Graph.from_lists(spark, *pieces(7, 5))
    want = rows(g.cycle_basis())
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    monkeypatch.setattr(graph_module, "COMPONENT_EDGES", 5)
    monkeypatch.setattr(spread, "MOST_LEVELS", 0)
    assert rows(g.cycle_basis()) == want
