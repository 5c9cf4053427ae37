"""One-shot functions over Python sequences; each builds a graph and returns the operator's DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.bayes import estimate_cpds, hill_climb_k2, k2_local_score
from .operators.graph import Graph
from .operators.whatif import for_each_edge_excluded

__all__ = [
    "Graph", "articulation_points", "bfs", "biconnected_components", "bridges", "connected_components", "connected_components_with_branch_ids", "cycle_basis", "dag_longest_path", "eccentricity",
    "estimate_cpds", "for_each_edge_excluded", "hill_climb_k2", "k2_local_score", "multi_source_shortest_path_lengths", "nodes_on_simple_paths", "shortest_path", "shortest_path_lengths",
    "strongly_connected_components", "topological_sort", "two_edge_connected_components", "weakly_connected_components",
]


def _graph(node_ids, edges, dst=None, directed=False, **more) -> Graph:
    return Graph.from_lists(SparkSession.getActiveSession(), node_ids, edges, dst, directed=directed, **more)


def connected_components(node_ids, edges, dst=None) -> DataFrame:
    return _graph(node_ids, edges, dst).connected_components()


def connected_components_with_branch_ids(node_ids, edges, branch_ids) -> DataFrame:
    return _graph(node_ids, edges, branch_ids=branch_ids).connected_components_with_branch_ids()


def bridges(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges).bridges()


def articulation_points(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges).articulation_points()


def biconnected_components(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges).biconnected_components()


def two_edge_connected_components(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges).two_edge_connected_components()


def cycle_basis(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges).cycle_basis()


def nodes_on_simple_paths(node_ids, edges, source, targets) -> DataFrame:
    return _graph(node_ids, edges).nodes_on_simple_paths(source, targets)


def bfs(node_ids, edges, source) -> DataFrame:
    return _graph(node_ids, edges).bfs(source)


def shortest_path(node_ids, edges, weights, source, target) -> DataFrame:
    return _graph(node_ids, edges, weights=weights).shortest_path(source, target)


def shortest_path_lengths(node_ids, edges, weights, source, cutoff=None) -> DataFrame:
    return _graph(node_ids, edges, weights=weights).shortest_path_lengths(source, cutoff=cutoff)


def multi_source_shortest_path_lengths(node_ids, edges, weights, sources, cutoff=None) -> DataFrame:
    return _graph(node_ids, edges, weights=weights).multi_source_shortest_path_lengths(sources, cutoff=cutoff)


def eccentricity(node_ids, edges, weights, source) -> DataFrame:
    return _graph(node_ids, edges, weights=weights).eccentricity(source)


def strongly_connected_components(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges, directed=True).strongly_connected_components()


def weakly_connected_components(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges, directed=True).weakly_connected_components()


def topological_sort(node_ids, edges) -> DataFrame:
    return _graph(node_ids, edges, directed=True).topological_sort()


def dag_longest_path(node_ids, edges, weights=None) -> DataFrame:
    return _graph(node_ids, edges, directed=True, weights=weights).dag_longest_path()
