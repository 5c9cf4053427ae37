"""Graphs as two DataFrames, views of them, and the operators on both.

``nodes(node_id long)`` and ``edges(edge_id long, src long, dst long, branch_id long, weight double)``; parallel edges
and self-loops are kept. A view is a graph whose tables are lazily filtered, so every operator works on it.
Every operator returns a DataFrame in long form, without an order.

Execution: lookups and views are single plans. Iterative operators first count the edges: up to
``KERNEL_EDGES`` one task runs an array kernel on the whole graph; beyond that, components and traversals
run as loops of joins over written tables, and structure operators run a kernel for each component in parallel;
components of more than ``COMPONENT_EDGES`` edges are solved by joins (``spread``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import bucketed, buckets, materialize
from . import kernels, spread, waves
from .labels import join_hot, label_components

#: Edges up to which one task takes the whole graph; edges of a component that one task takes (about 350 bytes an edge).
KERNEL_EDGES, COMPONENT_EDGES = 2_000_000, 2_000_000
EDGE_COLUMNS = {"edge_id": "long", "src": "long", "dst": "long", "branch_id": "long", "weight": "double"}


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, directed: bool = False, *, masked: DataFrame | None = None, strict: bool = False, unique: bool = False):
        """``strict`` checks in one job that all endpoints are known nodes (``ValueError`` if not); ``unique``: no node is told twice."""
        self.spark: SparkSession = nodes.sparkSession
        self.directed = directed
        self.nodes = nodes.select(F.col("node_id").cast("long"))
        if not unique:
            self.nodes = self.nodes.distinct()
        have = set(edges.columns)
        self.all_edges = edges.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()])
        self.masked = masked
        self._written: DataFrame | None = None
        if strict:
            ends = self.all_edges.select(F.col("src").alias("node_id")).union(self.all_edges.select("dst"))
            if not ends.join(self.nodes, "node_id", "left_anti").isEmpty():
                raise ValueError("edge references unknown node ID")

    @classmethod
    def from_lists(cls, spark: SparkSession, node_ids, edges, dst=None, *, branch_ids=None, weights=None, directed: bool = False) -> Graph:
        """From Python sequences: pairs, or two flat lists; an edge's place is its id."""
        pairs = list(edges) if dst is None else list(zip(edges, dst, strict=True))
        if any(len(p) != 2 for p in pairs):
            raise ValueError("each edge must be a 2-tuple")
        branch, weight = list(branch_ids or []), list(weights or [])
        rows = [(k, int(a), int(b), branch[k] if k < len(branch) else None, float(weight[k]) if k < len(weight) else None) for k, (a, b) in enumerate(pairs)]
        edge_df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in EDGE_COLUMNS.items()))
        return cls(spark.createDataFrame([(int(n),) for n in node_ids], "node_id long"), edge_df, directed, strict=True)

    # tables

    @property
    def edges(self) -> DataFrame:
        """Edges whose endpoints are not excluded."""
        if self.masked is None:
            return self.all_edges
        e = self.all_edges
        for c in ("src", "dst"):
            e = e.join(self.masked.select(F.col("node_id").alias(c)), c, "left_anti")
        return e.select(*EDGE_COLUMNS)

    def _both(self, loops_twice: bool = True) -> DataFrame:
        """Each edge from both ends, in one pass over the edges."""
        there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
        ends = F.array(there, back)
        if not loops_twice:
            ends = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(ends)
        return self.edges.withColumn("end", F.explode(ends)).select("edge_id", "end.src", "end.dst", "branch_id", "weight")

    def _ahead(self) -> DataFrame:
        return self.edges if self.directed else self._both(False)

    def _ids(self, ids, name: str) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0]).cast("long").alias(name)).distinct()
        return self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], f"{name} long")

    def _with(self, nodes=None, edges=None, masked=None, unique: bool = True) -> Graph:
        return Graph(nodes if nodes is not None else self.nodes, edges if edges is not None else self.all_edges, self.directed, masked=masked if masked is not None else self.masked, unique=unique)

    def _rows(self, *columns: str) -> DataFrame:
        """The edges with these columns, or all, written at the first call, so that counting them and the operator after it read the same table."""
        if self._written is None or not set(columns or EDGE_COLUMNS) <= set(self._written.columns):
            self._written = materialize(self.edges.select(*columns) if columns else self.edges, "edges")
        return self._written

    def persist(self) -> Graph:
        """Parse once: write both tables, so that several operators share them."""
        kept = Graph(materialize(self.nodes, "nodes"), materialize(self.all_edges, "edges"), self.directed, masked=self.masked, unique=True)
        if self.masked is None:
            kept._written = kept.all_edges
        return kept

    # sizes and guards

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def is_multigraph(self) -> bool:
        a, b = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return not self.edges.groupBy(a.alias("a"), b.alias("b")).count().where("count > 1").isEmpty()

    def _undirected(self, what: str) -> None:
        if self.directed:
            raise TypeError(f"{what} is not defined for directed graphs")

    def _directed(self, what: str) -> None:
        if not self.directed:
            raise TypeError(f"{what} requires a directed graph")

    # lookups: all nodes at once, or one

    def _one(self, df: DataFrame, node: int | None, column: str = "node_id") -> DataFrame:
        return df if node is None else df.where(F.col(column) == node)

    def _neighbors(self, e: DataFrame, node: int | None) -> DataFrame:
        return self._one(e.where("src <> dst").select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor")), node).distinct()

    def neighbors(self, node: int | None = None) -> DataFrame:
        return self._neighbors(self.edges if self.directed else self._both(), node)

    def successors(self, node: int | None = None) -> DataFrame:
        self._directed("successors")
        return self._neighbors(self.edges, node)

    def predecessors(self, node: int | None = None) -> DataFrame:
        self._directed("predecessors")
        return self._neighbors(self.edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")), node)

    def _degrees(self, e: DataFrame, end: str, node: int | None) -> DataFrame:
        counts = self._one(e.select(F.col(end).alias("node_id")), node).groupBy("node_id").count()
        return self._one(self.nodes, node).join(counts, "node_id", "left").select("node_id", F.coalesce("count", F.lit(0)).cast("long").alias("degree"))

    def degree(self, node: int | None = None) -> DataFrame:
        """Incident edge ends; a self-loop counts twice. Directed: the out-degree."""
        return self._degrees(self.edges if self.directed else self._both(), "src", node)

    def out_degree(self, node: int | None = None) -> DataFrame:
        self._directed("out_degree")
        return self._degrees(self.edges, "src", node)

    def in_degree(self, node: int | None = None) -> DataFrame:
        self._directed("in_degree")
        return self._degrees(self.edges, "dst", node)

    def incident_edge_indices(self, node: int | None = None) -> DataFrame:
        return self._one(self._ahead().select(F.col("src").alias("node_id"), "edge_id"), node)

    def outgoing_edge_indices(self, node: int | None = None) -> DataFrame:
        self._directed("outgoing_edge_indices")
        return self._one(self.edges.select(F.col("src").alias("node_id"), "edge_id"), node)

    def incoming_edge_indices(self, node: int | None = None) -> DataFrame:
        self._directed("incoming_edge_indices")
        return self._one(self.edges.select(F.col("dst").alias("node_id"), "edge_id"), node)

    def edge_indices(self, u: int, v: int) -> DataFrame:
        along = (F.col("src") == u) & (F.col("dst") == v)
        against = (F.col("src") == v) & (F.col("dst") == u)
        return self.edges.where(along if self.directed else along | against).select("edge_id")

    def edge_indices_between(self, pairs: DataFrame) -> DataFrame:
        """(u, v, edge_id) for each edge between the nodes of each different pair (u, v)."""
        return pairs.select("u", "v").distinct().join(self._ahead().select(F.col("src").alias("u"), F.col("dst").alias("v"), "edge_id"), ["u", "v"])

    # views

    def without_edges(self, edge_ids) -> Graph:
        gone = self._ids(edge_ids, "edge_id")
        if not isinstance(edge_ids, DataFrame) and gone.join(self.all_edges, "edge_id", "left_anti").count():
            raise IndexError("edge index out of range")
        return self._with(edges=self.all_edges.join(gone, "edge_id", "left_anti"))

    def without_branches(self, branch_ids) -> Graph:
        """Drops every edge of the branches."""
        known = self.all_edges.where("branch_id is not null")
        if known.isEmpty():
            raise ValueError("no branch_ids")
        gone = self._ids(branch_ids, "branch_id")
        if not isinstance(branch_ids, DataFrame) and not gone.join(known, "branch_id", "left_anti").isEmpty():
            raise KeyError("unknown branch ID")
        return self._with(edges=self.all_edges.join(gone, "branch_id", "left_anti"))

    def without_nodes(self, node_ids) -> Graph:
        gone = self._ids(node_ids, "node_id")
        masked = gone if self.masked is None else self.masked.union(gone).distinct()
        return self._with(nodes=self.nodes.join(gone, "node_id", "left_anti"), masked=masked)

    def with_edges(self, pairs) -> Graph:
        """Adds edges (and their nodes); ids go on after the largest. Exclusions and branches stay."""
        if not isinstance(pairs, DataFrame):
            base = self.all_edges.agg(F.max("edge_id")).first()[0]
            pairs = self.spark.createDataFrame([((-1 if base is None else base) + 1 + k, int(a), int(b)) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
        new = pairs.select("edge_id", "src", "dst", *[(F.col(c) if c in pairs.columns else F.lit(None)).cast(EDGE_COLUMNS[c]).alias(c) for c in ("branch_id", "weight")])
        ends = new.select(F.col("src").alias("node_id")).union(new.select("dst"))
        if self.masked is not None:
            ends = ends.join(self.masked, "node_id", "left_anti")
        return self._with(nodes=self.nodes.union(ends), edges=self.all_edges.unionByName(new), unique=False)

    def split_node(self, node: int, new_node: int, edge_ids) -> Graph:
        """The listed edges leave ``node`` for ``new_node``; a self-loop moves its first end."""
        if self.nodes.where(F.col("node_id") == node).isEmpty():
            raise ValueError(f"node {node} is not in the graph")
        if not self.nodes.where(F.col("node_id") == new_node).isEmpty():
            raise ValueError(f"node {new_node} is already in the graph")
        moved = self._ids(edge_ids, "edge_id")
        hit = moved.join(self.all_edges, "edge_id", "left").agg(F.count(F.when(F.col("src").isNull(), 1)), F.count(F.when((F.col("src") != node) & (F.col("dst") != node), 1))).first()
        if hit[0]:
            raise IndexError("edge index out of range")
        if hit[1]:
            raise ValueError(f"an edge is not incident to node {node}")
        e = self.all_edges.join(moved.withColumn("moved", F.lit(True)), "edge_id", "left")
        first = F.col("moved") & (F.col("src") == node)
        e = e.withColumn("dst", F.when(F.col("moved") & ~(F.col("src") == node) & (F.col("dst") == node), F.lit(new_node)).otherwise(F.col("dst")))
        e = e.withColumn("src", F.when(first, F.lit(new_node)).otherwise(F.col("src")))
        return self._with(nodes=self.nodes.union(self._ids([new_node], "node_id")), edges=e.select(*EDGE_COLUMNS))

    # running kernels

    def _small(self, *columns: str) -> bool:
        return self._rows(*columns).count() <= KERNEL_EDGES

    def _whole(self, kernel, schema: str, columns: tuple[str, ...] = ("edge_id", "src", "dst"), nodes: bool = True) -> DataFrame:
        """One task over the graph; only for graphs whose size was checked."""
        rows = self._rows(*columns).select(*columns)
        if nodes:  # without a target
            rows = rows.union(self.nodes.select(*[F.col("node_id") if c == "src" else F.lit(None).cast(EDGE_COLUMNS[c]) for c in columns]))
        return rows.repartition(1).mapInArrow(_once(kernel, schema), schema)

    def _by_component(self, kernel, schema: str, apart, columns: tuple[str, ...] = ("edge_id", "src", "dst")) -> DataFrame:
        """A kernel over each connected component's edges; all edges in one task if the graph is small.

        ``apart`` gives the same rows by joins, for components of more than ``COMPONENT_EDGES`` edges.
        """
        if self._small(*columns):
            return self._whole(kernel, schema, columns, nodes=False)
        edges = self._rows(*columns)
        labels = label_components(edges, KERNEL_EDGES)
        rows = edges.join(labels, F.col("src") == F.col("node_id"), "left").select(F.coalesce("component_id", "src").alias("component_id"), *columns)
        rows = materialize(rows, "by-component")
        large = materialize(rows.groupBy("component_id").count().where(F.col("count") > COMPONENT_EDGES).select("component_id"), "large")
        one = _table(kernel, schema)
        fit = rows.join(large, "component_id", "left_anti").groupBy("component_id").applyInArrow(lambda t: one(t.drop_columns(["component_id"])), schema)
        return fit if large.isEmpty() else fit.union(apart(rows.join(large, "component_id", "left_semi")))

    # components

    def connected_components(self) -> DataFrame:
        """(node_id, component_id): the smallest node of the component."""
        self._undirected("connected_components")
        return self._components()

    def weakly_connected_components(self) -> DataFrame:
        self._directed("weakly_connected_components")
        return self._components()

    def _components(self) -> DataFrame:
        if self._small("src", "dst"):

            def run(g: Arrays):
                return g.ids, g.ids[kernels.union_labels(g.n, g.src, g.dst)]

            labels = self._whole(run, "node_id long, component_id long", ("src", "dst"), nodes=False)
        else:
            labels = label_components(self._rows("src", "dst"), KERNEL_EDGES)
        return self.nodes.join(labels, "node_id", "left").select("node_id", F.coalesce("component_id", "node_id").alias("component_id"))

    def connected_components_with_branch_ids(self) -> DataFrame:
        """(component_id, node_id, branch_id): a row for each node and each branch of a component, the other null.

        A branch belongs to the component of its edge's kept source, else of its kept target; if both are excluded it
        stands alone under the target.
        """
        self._undirected("connected_components_with_branch_ids")
        labels = materialize(self._components(), "labels")
        a, b = (labels.select(F.col("node_id").alias(c), F.col("component_id").alias(f"{c}_c")) for c in ("src", "dst"))
        at = self.all_edges.where("branch_id is not null").join(a, "src", "left").join(b, "dst", "left")
        branches = at.select(F.coalesce("src_c", "dst_c", "dst").alias("component_id"), F.lit(None).cast("long").alias("node_id"), "branch_id").distinct()
        return labels.select("component_id", "node_id", F.lit(None).cast("long").alias("branch_id")).union(branches)

    def strongly_connected_components(self) -> DataFrame:
        """(node_id, scc_id): the smallest node of the component. Kernels run on the edges of each weak component."""
        self._directed("strongly_connected_components")

        def run(g: Arrays):
            return g.ids, g.ids[kernels.strong_components(g.n, g.src, g.dst)]

        labels = self._by_component(run, "node_id long, scc_id long", spread.strong_components, ("src", "dst"))
        return self.nodes.join(labels, "node_id", "left").select("node_id", F.coalesce("scc_id", "node_id").alias("scc_id"))

    # structure

    def bridges(self) -> DataFrame:
        """(edge_id, src, dst, branch_id) of edges whose loss disconnects their ends."""
        self._undirected("bridges")
        rows = self._rows()
        return rows.join(self._bridge_ids(), "edge_id").select("edge_id", "src", "dst", "branch_id")

    def _bridge_ids(self) -> DataFrame:
        def run(g: Arrays):
            label = kernels.block_labels(g.n, g.src, g.dst)
            alone = np.bincount(label[label >= 0], minlength=g.n) == 1
            return (g.edge_id[(label >= 0) & alone[label]],)

        return self._by_component(run, "edge_id long", spread.bridges)

    def bridges_with_branch_ids(self) -> DataFrame:
        if self.all_edges.where("branch_id is not null").isEmpty():
            raise ValueError("no branch_ids")
        return self.bridges().select("src", "dst", "branch_id")

    def blocks(self) -> DataFrame:
        """(block_id, edge_id): biconnected components by edges; block_id is the smallest edge id. Loops are in none."""
        self._undirected("biconnected_components")

        def run(g: Arrays):
            label = kernels.block_labels(g.n, g.src, g.dst)
            edges, label = g.edge_id[label >= 0], label[label >= 0]
            least = np.full(g.n, np.iinfo(np.int64).max)
            np.minimum.at(least, label, edges)
            return least[label], edges

        return self._by_component(run, "block_id long, edge_id long", spread.blocks)

    def biconnected_components(self) -> DataFrame:
        """(block_id, node_id)."""
        at = self.blocks().join(self._rows("edge_id", "src", "dst"), "edge_id")
        return at.select("block_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()

    def articulation_points(self) -> DataFrame:
        """(node_id) of nodes in two blocks or more."""
        self._undirected("articulation_points")
        return self.biconnected_components().groupBy("node_id").count().where("count > 1").select("node_id")

    def two_edge_connected_components(self) -> DataFrame:
        """(node_id, component_id) of the graph without its bridges."""
        self._undirected("two_edge_connected_components")
        rows, cut = self._rows("edge_id", "src", "dst"), materialize(self._bridge_ids(), "bridges")
        return Graph(self.nodes, rows.join(cut, "edge_id", "left_anti"), unique=True)._components()

    def cycle_basis(self) -> DataFrame:
        """(cycle_id, position, node_id): a fundamental cycle for each edge outside a breadth-first forest."""
        self._undirected("cycle_basis")

        def run(g: Arrays):
            slot, position, node = kernels.cycle_rows(g.n, g.src, g.dst)
            return g.edge_id[slot], position, g.ids[node]

        return self._by_component(run, "cycle_id long, position long, node_id long", spread.cycle_basis)

    def nodes_on_simple_paths(self, source: int, targets) -> DataFrame:
        """(node_id) on some simple path from the source to a target: the blocks on the way in the block-cut tree."""
        self._undirected("nodes_on_simple_paths")
        wanted = self._ids(targets, "node_id").join(self.nodes, "node_id", "left_semi")
        wanted = materialize(wanted, "targets")
        members = materialize(self.biconnected_components(), "members")
        itself = wanted.where(F.col("node_id") == source)
        if members.where(F.col("node_id") == source).isEmpty():
            return itself
        if members.count() <= KERNEL_EDGES:
            rows = members.union(wanted.select(F.lit(None).cast("long"), "node_id")).repartition(1)
            return rows.mapInArrow(_between(source), "node_id long").union(itself).distinct()
        # larger: a breadth-first walk of the tree of blocks and the nodes that lead on, which get numbers of their own; it is a forest, so ties do not matter
        on = members.groupBy("node_id").count().where("count > 1").select("node_id").union(wanted).union(self._ids([source], "node_id")).distinct()
        few = materialize(members.join(on, "node_id", "left_semi").select("block_id", "node_id"), "few")
        names = few.select(F.lit(0).alias("kind"), F.col("node_id").alias("name")).union(few.select(F.lit(1), "block_id")).distinct()
        names = materialize(names.withColumn("at", F.monotonically_increasing_id()), "names")
        of = lambda kind, name: names.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("at").alias(f"{name}_at"))
        at = materialize(join_hot(few.join(of(0, "node_id"), "node_id"), of(1, "block_id"), "block_id"), "tree")
        root = at.where(F.col("node_id") == source).first()["node_id_at"]
        tree = at.select(F.col("node_id_at").alias("edge_id"), F.col("node_id_at").alias("src"), F.col("block_id_at").alias("dst"))
        walk = materialize(Graph(names.select(F.col("at").alias("node_id")), tree, unique=True).bfs(root), "walk")
        ends = at.join(wanted.where(F.col("node_id") != source), "node_id", "left_semi").select(F.col("node_id_at").alias("node_id")).distinct()
        used = front = materialize(walk.join(ends, "node_id").select("node_id", "parent"), "on")
        while not front.isEmpty():
            above = walk.join(front.select(F.col("parent").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", "parent")
            front = materialize(above.join(used.select("node_id"), "node_id", "left_anti"), "front")
            used = used.union(front)
        hit = materialize(at.join(used.select(F.col("node_id").alias("block_id_at")), "block_id_at", "left_semi").select("block_id").distinct(), "hit")
        return join_hot(members, hit.withColumn("on", F.lit(True)), "block_id").where("on").select("node_id").union(itself).distinct()

    # traversal

    def _known(self, node: int) -> bool:
        return not self.nodes.where(F.col("node_id") == node).isEmpty()

    def bfs(self, source: int) -> DataFrame:
        """(node_id, level, visit_rank, parent) of reachable nodes; neighbours are visited by ascending edge id."""
        if not self._known(source):
            masked = self.masked is not None and not self.masked.where(F.col("node_id") == source).isEmpty()
            raise ValueError("source node is excluded" if masked else "source not in node_ids")
        schema = "node_id long, level long, visit_rank long, parent long"
        if self._small("edge_id", "src", "dst"):
            directed = self.directed

            def run(g: Arrays):
                nodes, level, parent = kernels.visit_order(g.n, g.src, g.dst, directed, g.place(source))
                return g.ids[nodes], level, np.arange(len(nodes)), [None if p < 0 else int(g.ids[p]) for p in parent]

            return self._whole(run, schema)
        e = self._rows("edge_id", "src", "dst").select(F.col("src").alias("at"), F.col("dst").alias("node"), "edge_id")
        n = buckets(e.count() if self.directed else 2 * e.count())
        both = e if self.directed else e.union(e.where("at <> node").select("node", "at", "edge_id"))
        found, _ = waves.forest(self._ids([source], "node"), bucketed(both, "at", n, "ahead"), n, ranked=True)
        return found.select(F.col("node").alias("node_id"), "level", F.col("rank").alias("visit_rank"), "parent")

    def _weighted(self, weights: DataFrame | None) -> Graph:
        g = self
        if weights is not None:
            g = self._with(edges=self.all_edges.drop("weight").join(weights.select("edge_id", F.col("weight").cast("double")), "edge_id", "left"))
        bad = g._rows("src", "dst", "weight").agg(F.count(F.when(F.col("weight").isNull(), 1)), F.count(F.when(F.col("weight") < 0, 1))).first()
        if bad[0] or bad[1]:
            raise ValueError(f"{bad[0]} edges without a weight, {bad[1]} negative weights")
        return g

    def _paths(self, weights: DataFrame | None, sources: list[int], cutoff: float | None) -> DataFrame:
        """(node_id, distance) of what the sources reach."""
        g = self._weighted(weights)
        cutoff = None if cutoff is None or cutoff < 0 else cutoff
        if g._small("src", "dst", "weight"):
            directed = self.directed

            def run(a: Arrays):
                d, _, _ = kernels.distances(a.n, a.src, a.dst, a.weight, directed, [a.place(s) for s in dict.fromkeys(sources) if a.has(s)], cutoff)
                hit = np.flatnonzero(np.isfinite(d))
                return a.ids[hit], d[hit]

            return g._whole(run, "node_id long, distance double", ("src", "dst", "weight"))
        return waves.distances(*g._wave_inputs(sources), cutoff)

    def _wave_inputs(self, sources: list[int]) -> tuple[DataFrame, DataFrame, int, float]:
        """Known sources, the edges ahead in buckets by src, how many buckets, and the mean weight."""
        starts = self._ids(sources, "node_id").join(self.nodes, "node_id", "left_semi")
        count, mean = self._rows("src", "dst", "weight").agg(F.count(F.lit(1)), F.avg("weight")).first()
        n = buckets(count if self.directed else 2 * count)
        return starts, bucketed(self._written_ahead(), "src", n, "ahead"), n, mean or 0.0

    def _written_ahead(self) -> DataFrame:
        """(src, dst, weight) in the directions in which edges are walked, from the written table."""
        e = self._rows("src", "dst", "weight").select("src", "dst", "weight")
        return e if self.directed else e.union(e.where("src <> dst").select("dst", "src", "weight"))

    def shortest_path_lengths(self, source: int, weights: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
        """(node_id, distance) of reachable nodes; an inclusive cutoff, none if negative; empty for unknown sources."""
        return self._paths(weights, [source], cutoff)

    def multi_source_shortest_path_lengths(self, sources, weights: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
        return self._paths(weights, list(sources), cutoff)

    def eccentricity(self, source: int, weights: DataFrame | None = None) -> DataFrame:
        return self.shortest_path_lengths(source, weights).agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("eccentricity"))

    def shortest_path(self, source: int, target: int, weights: DataFrame | None = None) -> DataFrame:
        """(position, node_id, distance) along a path of least (distance, hops, predecessors); empty if there is none."""
        schema = "position long, node_id long, distance double"
        if not self._known(source) or not self._known(target):
            return self.spark.createDataFrame([], schema)
        if source == target:
            return self.spark.createDataFrame([(0, source, 0.0)], schema)
        g = self._weighted(weights)
        if g._small("src", "dst", "weight"):
            directed = self.directed

            def run(a: Arrays):
                d, _, pred = kernels.distances(a.n, a.src, a.dst, a.weight, directed, [a.place(source)], None)
                at, path = a.place(target), []
                while at >= 0 and np.isfinite(d[at]):
                    path.append(at)
                    at = int(pred[at])
                path = np.array(path[::-1], np.int64)
                return np.arange(len(path)), a.ids[path], d[path]

            return g._whole(run, schema, ("src", "dst", "weight"))
        # all edges on paths of least distance to the target make a graph with the same labels, mostly a small one
        starts, ahead, n, step = g._wave_inputs([source])
        found = bucketed(waves.distances(starts, ahead, n, step, None), "node_id", n, "found")
        into = bucketed(ahead, "dst", n, "into") if self.directed else ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        on = materialize(waves.tight(found, into, target), "on-paths")
        if on.isEmpty():
            return self.spark.createDataFrame([], schema)
        if on.count() <= KERNEL_EDGES:
            return Graph(on.select(F.explode(F.array("src", "dst")).alias("node_id")), on, True).shortest_path(source, target)
        # larger: hops along these edges, then back by the edges that make up the hops
        from_, hop_n = self._ids([source], "node_id"), buckets(on.count())
        hops = bucketed(waves.distances(from_, bucketed(on.select("src", "dst", F.lit(1.0).alias("weight")), "src", hop_n, "ahead"), hop_n, 0.0, None), "node_id", hop_n, "hops")
        at, path = target, []
        while at is not None:
            d = found.where(F.col("node_id") == at).first()["distance"]
            h = hops.where(F.col("node_id") == at).first()["distance"]
            path.append((at, d))
            before = on.where(F.col("dst") == at).select(F.col("src").alias("node_id")).join(hops.where(F.col("distance") == h - 1), "node_id", "left_semi")
            at = before.agg(F.min("node_id")).first()[0] if h else None
        return self.spark.createDataFrame([(k, n, d) for k, (n, d) in enumerate(reversed(path))], schema)

    def all_edge_paths(self, source: int, targets, cutoff: int | None = None, node_simple: bool = False) -> DataFrame:
        """(path array of edge ids) of every trail from the source that ends at a target; goes on past targets.

        ``cutoff`` bounds the edges, none if not positive. ``node_simple``: nodes are not entered twice, though a
        visited node may still be reported as a target. The number of trails can be exponential: pass a cutoff.
        """
        if not self._known(source):
            raise ValueError("source node is excluded or unknown")
        wanted = materialize(self._ids(targets, "node_id").join(self.nodes, "node_id", "left_semi"), "targets")
        ahead = materialize(self._ahead().select(F.col("src").alias("node"), F.col("dst").alias("to"), "edge_id"), "ahead")
        front = self.spark.createDataFrame([(source, [], [source])], "node long, path array<long>, visited array<long>")
        found, k = None, 0
        while cutoff is None or cutoff <= 0 or k < cutoff:
            k += 1
            step = front.join(ahead, "node").where(~F.array_contains("path", F.col("edge_id")))
            step = materialize(step.select(F.col("to").alias("node"), F.array_append("path", F.col("edge_id")).alias("path"), "visited"), "trails")
            if step.isEmpty():
                break
            hit = step.join(wanted.select(F.col("node_id").alias("node")), "node", "left_semi").select("path")
            found = hit if found is None else found.union(hit)
            front = step.where(~F.array_contains("visited", F.col("node"))) if node_simple else step
            if node_simple:
                front = front.withColumn("visited", F.array_append("visited", F.col("node")))
        return found if found is not None else self.spark.createDataFrame([], "path array<long>")

    # directed order

    def _levels(self, what: str) -> DataFrame:
        """(node_id, level), level the most edges that lead to the node; raises on a cycle."""
        if self._small("src", "dst"):

            def run(g: Arrays):
                return g.ids, kernels.levels(g.n, g.src, g.dst)

            out = materialize(self._whole(run, "node_id long, level long", ("src", "dst")), "levels")
            stuck = out.where("level < 0").count()
        else:
            rows = self._rows("src", "dst").select("src", "dst", F.lit(0.0).alias("weight"))
            out, stuck = waves.order(self.nodes, rows, rows.count(), KERNEL_EDGES)
            out = out.select("node_id", "level")
        if stuck:
            n = self.node_count()
            raise ValueError(f"Graph contains a cycle - {what} is undefined" + (f" ({n - stuck} of {n} nodes processed)" if what.startswith("topo") else ""))
        return out

    def topological_sort(self) -> DataFrame:
        """(node_id, level): ordering by (level, node_id) is a topological order. ``ValueError`` on a cycle."""
        self._directed("topological_sort")
        return self._levels("topological sort")

    def dag_longest_path(self, weights: DataFrame | None = None, unit: bool = False) -> DataFrame:
        """(position, node_id, length) of a longest path; unit weights if none are given and edges have none."""
        self._directed("dag_longest_path")
        g = self._with(edges=self.all_edges.withColumn("weight", F.lit(1.0))) if unit else self._with(edges=self.all_edges.withColumn("weight", F.coalesce("weight", F.lit(1.0))))
        if weights is not None:
            g = self._with(edges=self.all_edges.drop("weight").join(weights.select("edge_id", F.col("weight").cast("double")), "edge_id"))
        schema = "position long, node_id long, length double"
        if g._small("src", "dst", "weight"):

            def run(a: Arrays):
                level = kernels.levels(a.n, a.src, a.dst)
                if (level < 0).any():
                    return [-1], [None], [None]
                length, path = kernels.longest(a.n, a.src, a.dst, a.weight, level)
                return np.arange(len(path)), a.ids[path] if path else np.zeros(0, np.int64), np.full(len(path), length)

            out = materialize(g._whole(run, schema, ("src", "dst", "weight")), "longest")
            if not out.where("position < 0").isEmpty():
                raise ValueError("Graph contains a cycle - dag_longest_path is undefined")
            return out
        rows = g._rows("src", "dst", "weight")
        found, stuck = waves.order(g.nodes, rows, rows.count(), KERNEL_EDGES)
        if stuck:
            raise ValueError("Graph contains a cycle - dag_longest_path is undefined")
        end = found.orderBy(F.desc("d"), "node_id").first()
        if end is None:
            return self.spark.createDataFrame([], schema)
        if found.count() <= KERNEL_EDGES:
            pairs = found.select("node_id", "pred").repartition(1)
            return materialize(pairs.mapInArrow(_back(end["node_id"], end["d"]), schema), "longest")
        path, at = [], end
        while at is not None:
            path.append(at["node_id"])
            at = found.where(F.col("node_id") == at["pred"]).first() if at["pred"] is not None else None
        return self.spark.createDataFrame([(k, n, end["d"]) for k, n in enumerate(reversed(path))], schema)


class Arrays:
    """The graph of a kernel: node ids, and edges with places for endpoints."""

    def __init__(self, table):
        import pyarrow.compute as pc

        edges = table.filter(pc.is_valid(table.column("dst")))
        lone = table.filter(pc.is_null(table.column("dst"))).column("src").to_numpy()
        col = lambda c: edges.column(c).to_numpy(zero_copy_only=False) if edges.num_rows else np.zeros(0, np.int64)
        # where edges have ids, kernels see them by id, whatever the order of arrival
        order = np.argsort(col("edge_id"), kind="stable") if "edge_id" in edges.column_names else slice(None)
        for c in ("edge_id", "weight"):
            if c in edges.column_names:
                setattr(self, c, col(c)[order])
        self.ids, (self.src, self.dst, _) = kernels.local_ids(col("src")[order], col("dst")[order], lone)
        self.n = len(self.ids)

    def place(self, node: int) -> int:
        return int(np.searchsorted(self.ids, node))

    def has(self, node: int) -> bool:
        at = self.place(node)
        return at < self.n and int(self.ids[at]) == node


def _table(kernel, schema: str):
    """A kernel over arrays as a function of Arrow tables."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]

    def run(table):
        return pa.table([pa.array(x, t) for x, (_, t) in zip(kernel(Arrays(table)), fields)], names=[n for n, _ in fields])

    return run


def _between(source: int):
    """Of rows (block_id, node_id), with null blocks for targets, the nodes of the blocks on the way from the source to a target."""
    import pyarrow as pa

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        told = table.column("block_id").is_valid().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        ids, nodes = np.unique(table.column("node_id").to_numpy(), return_inverse=True)
        blocks, at = np.unique(table.column("block_id").drop_null().to_numpy(), return_inverse=True)
        on = kernels.blocks_between(len(ids), len(blocks), nodes[told], at, int(np.searchsorted(ids, source)), nodes[~told])
        yield pa.RecordBatch.from_arrays([pa.array(ids[np.unique(nodes[told][on[at]])])], ["node_id"])

    return run


def _back(end: int, length: float):
    """Of rows (node_id, pred) the path that ends in a node, as (position, node_id, length)."""
    import pyarrow as pa

    def run(batches):
        before, path = {}, []
        for b in batches:
            before.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        at = end if end in before else None
        while at is not None:
            path.append(at)
            at = before.get(at)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(path)), pa.int64()), pa.array(path[::-1], pa.int64()), pa.array([length] * len(path), pa.float64())], ["position", "node_id", "length"])

    return run


def _once(kernel, schema: str):
    import pyarrow as pa

    one = _table(kernel, schema)

    def run(batches):
        held = list(batches)
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    return run
