import itertools
import random

import numpy as np
import pytest

from meshweave import Graph, for_each_edge_excluded
from meshweave.operators import graph as graph_module
from meshweave.operators import kernels


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def groups(df):
    out = {}
    for key, member in ((r[-1], r[0]) for r in df.collect()):
        out.setdefault(key, set()).add(member)
    return sorted(map(sorted, out.values()))


TRIANGLE_TAIL = ([0, 1, 2, 3], [(0, 1), (1, 2), (2, 0), (2, 3)])


@pytest.fixture(params=["kernel", "distributed"])
def tier(request, monkeypatch):
    if request.param == "distributed":
        monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    return request.param


def test_structure(spark, tier):
    g = Graph.from_lists(spark, *TRIANGLE_TAIL)
    assert rows(g.bridges().select("edge_id")) == [(3,)]
    assert rows(g.articulation_points()) == [(2,)]
    assert groups(g.two_edge_connected_components()) == [[0, 1, 2], [3]]
    assert sorted(b for _, b in rows(g.biconnected_components())) == [0, 1, 2, 2, 3]
    assert len({r[0] for r in g.cycle_basis().collect()}) == 1
    assert rows(g.nodes_on_simple_paths(0, [3])) == [(0,), (1,), (2,), (3,)]


def test_components_and_branches(spark, tier):
    g = Graph.from_lists(spark, [1, 2, 3, 4], [(1, 2), (2, 3)], branch_ids=[10, 20])
    assert groups(g.connected_components()) == [[1, 2, 3], [4]]
    got = g.without_nodes([1, 2, 3]).connected_components_with_branch_ids()
    assert {tuple(r) for r in got.collect()} == {(4, 4, None), (2, None, 10), (3, None, 20)}
    got = g.without_nodes([2]).connected_components_with_branch_ids()
    assert {tuple(r) for r in got.collect()} == {(1, 1, None), (3, 3, None), (4, 4, None), (1, None, 10), (3, None, 20)}


def test_paths(spark, tier):
    g = Graph.from_lists(spark, [0, 1, 2, 3, 9], [(0, 1), (0, 2), (1, 3), (2, 3)], weights=[1.0, 4.0, 2.0, 1.0])
    assert rows(g.shortest_path_lengths(0)) == [(0, 0.0), (1, 1.0), (2, 4.0), (3, 3.0)]
    assert rows(g.shortest_path_lengths(0, cutoff=3)) == [(0, 0.0), (1, 1.0), (3, 3.0)]
    assert rows(g.multi_source_shortest_path_lengths([0, 3, 77])) == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0)]
    assert [r["node_id"] for r in g.shortest_path(0, 3).orderBy("position").collect()] == [0, 1, 3]
    assert [r["node_id"] for r in g.without_nodes([1]).shortest_path(0, 3).orderBy("position").collect()] == [0, 2, 3]
    assert g.shortest_path(0, 9).count() == 0
    assert g.shortest_path_lengths(77).count() == 0
    assert rows(g.eccentricity(0)) == [(4.0,)]
    assert [(r["node_id"], r["level"]) for r in g.bfs(0).orderBy("visit_rank").collect()] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    with pytest.raises(ValueError, match="not in node_ids"):
        g.bfs(77)


def test_directed(spark, tier):
    g = Graph.from_lists(spark, range(1, 9), [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4), (7, 8)], directed=True)
    assert groups(g.strongly_connected_components()) == [[1, 2, 3], [4, 5, 6], [7], [8]]
    assert groups(g.weakly_connected_components()) == [[1, 2, 3, 4, 5, 6], [7, 8]]
    with pytest.raises(ValueError, match="cycle"):
        g.topological_sort()
    with pytest.raises(TypeError):
        g.bridges()
    d = Graph.from_lists(spark, [1, 2, 3], [(1, 2), (2, 3), (1, 3)], directed=True)
    assert rows(d.topological_sort()) == [(1, 0), (2, 1), (3, 2)]
    assert [r["node_id"] for r in d.dag_longest_path().orderBy("position").collect()] == [1, 2, 3]
    w = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 10.0)], "edge_id long, weight double")
    assert [r["node_id"] for r in d.dag_longest_path(w).orderBy("position").collect()] == [1, 3]


def test_lookups_and_views(spark):
    g = Graph.from_lists(spark, [0, 1, 2, 3], [(0, 0), (0, 1), (1, 2)])
    assert rows(g.degree()) == [(0, 3), (1, 2), (2, 1), (3, 0)]
    assert rows(g.neighbors(0)) == [(0, 1)]
    assert rows(g.incident_edge_indices(0)) == [(0, 0), (0, 1)]
    assert rows(g.edge_indices(2, 1)) == [(2,)]
    assert not g.is_multigraph()
    assert Graph.from_lists(spark, [0, 1], [0, 1], [1, 0]).is_multigraph()
    split = g.without_edges([0]).split_node(1, 99, [2])
    assert groups(split.connected_components()) == [[0, 1], [2, 99], [3]]
    assert rows(g.with_edges([(2, 7)]).degree(7)) == [(7, 1)]
    with pytest.raises(IndexError):
        g.without_edges([5])
    with pytest.raises(ValueError, match="no branch_ids"):
        g.without_branches([1])
    with pytest.raises(ValueError):
        Graph.from_lists(spark, [0], [(0, 1)])
    got = {i: df.select("component_id").distinct().count() for i, df in for_each_edge_excluded(g, "connected_components")}
    assert got == {0: 2, 1: 3, 2: 3}


def test_edge_paths(spark):
    g = Graph.from_lists(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 1), (1, 4)])
    assert [[3], [0, 1, 2, 3]] == sorted((r[0] for r in g.all_edge_paths(1, [4]).collect() if r[0] in ([3], [0, 1, 2, 3])), key=len)
    assert [r[0] for r in g.all_edge_paths(1, [4], node_simple=True).collect()] == [[3]]
    d = Graph.from_lists(spark, [0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert sorted(r[0] for r in d.all_edge_paths(0, [3], cutoff=2).collect()) == [[0, 2], [1, 3]]
    assert d.all_edge_paths(0, [3], cutoff=1).count() == 0


def test_kernels_against_deletion():
    rng = random.Random(7)
    for _ in range(300):
        n, m = rng.randint(1, 7), rng.randint(0, 11)
        src, dst = (np.array([rng.randrange(n) for _ in range(m)], np.int64) for _ in range(2))
        count = lambda keep, nodes: len({*kernels.union_labels(n, src[keep], dst[keep])[nodes].tolist()})
        every, all_nodes = np.arange(m), np.arange(n)
        bridges, blocks = kernels.low_links(n, src, dst)
        assert sorted(bridges) == [e for e in range(m) if count(np.delete(every, e), all_nodes) > count(every, all_nodes)]
        seen = [v for b in blocks for v in {*src[b].tolist(), *dst[b].tolist()}]
        cuts = {v for v in seen if seen.count(v) > 1}
        without = {v for v in range(n) if count(every[(src != v) & (dst != v)], np.delete(all_nodes, v)) > count(every, all_nodes) - (not ((src == v) & (dst != v) | (dst == v) & (src != v)).any())}
        assert cuts == without
        assert sorted(e for b in blocks for e in b) == [e for e in range(m) if src[e] != dst[e]]
        assert len(kernels.fundamental_cycles(n, src, dst)) == m - n + count(every, all_nodes)
        reach = np.eye(n, dtype=bool)
        reach[src, dst] = True
        for k, i in itertools.product(range(n), range(n)):
            reach[i] |= reach[i, k] & reach[k]
        assert kernels.strong_components(n, src, dst).tolist() == [min(w for w in range(n) if reach[v, w] and reach[w, v]) for v in range(n)]
