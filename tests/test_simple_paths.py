import itertools
import random

import pytest

from meshweave import Graph
from meshweave.operators import graph as graph_module


def brute(edges, source, targets):
    """Nodes of all simple paths, one after the other."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {t for t in targets if t == source}

    def walk(path):
        if path[-1] in targets and len(path) > 1:
            out.update(path)
        for w in near.get(path[-1], ()):
            if w not in path:
                walk([*path, w])

    walk([source])
    return out


@pytest.mark.parametrize("kernel_edges", [2_000_000, 0])
@pytest.mark.parametrize("start", [0, (1 << 53) + 1, (1 << 62) + 3])
def test_large_edge_and_node_ids(spark, monkeypatch, kernel_edges, start):
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", kernel_edges)
    rng = random.Random(start % 97 + kernel_edges % 7)
    pairs = [(a, b) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.25] + [(0, 1), (1, 2), (2, 3), (2, 3), (3, 3)]
    rows = [(start + k, start + a, start + b) for k, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long")
    nodes = spark.createDataFrame([(start + k,) for k in range(9)], "node_id long")
    for targets in ([3], [7, 3], [0], [8]):
        got = {r[0] - start for r in Graph(nodes, edges).nodes_on_simple_paths(start, [start + t for t in targets]).collect()}
        assert got == brute(pairs, 0, targets)
