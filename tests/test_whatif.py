import random

import pytest

from meshweave import Graph, for_each_edge_excluded, queries
from meshweave.operators import graph as graph_module
from meshweave.operators.whatif import components_without_each_edge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [graph_module.KERNEL_EDGES, 0])
def test_each_edge_against_deletion(spark, monkeypatch, most):
    # a triangle with a tail, a pair of parallel edges, a loop, a lone node and a masked one
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (5, 5), (7, 8), (8, 9)]
    g = Graph.from_lists(spark, range(10), pairs).without_nodes([9])
    want = {i: df.select("component_id").distinct().count() for i, df in for_each_edge_excluded(g, "connected_components")}
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", most)
    got = [tuple(r) for r in components_without_each_edge(g).collect()]
    assert sorted(got) == sorted(want.items())
    assert {n for _, n in got} == {3, 4}


def test_query_has_every_edge(spark):
    g = queries.order_part(spark, SF)
    edges, nodes = [tuple(r) for r in g.edges.select("edge_id", "src", "dst").collect()], [r[0] for r in g.nodes.collect()]
    got = dict(tuple(r) for r in queries.QUERIES["for_each_edge_excluded"](spark, SF).collect())
    assert set(got) == {e for e, _, _ in edges}
    cut = [e for e in got if got[e] > min(got.values())]
    some = random.Random(5).sample(edges, 40) + [x for x in edges if x[0] in set(cut[:40])]
    for gone, _, _ in some:
        up = {v: v for v in nodes}

        def root(v):
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        for e, a, b in edges:
            if e != gone:
                up[root(a)] = root(b)
        assert got[gone] == len({root(v) for v in nodes})
