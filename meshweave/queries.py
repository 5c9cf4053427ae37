"""Registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bayes
from .operators.whatif import components_without_each_edge
from .sources.tables import DEPENDENT_CARDS, ID_STEP, K2_CARDS, PLACES, dependent_samples, order_part, part_next, samples


def _op(method, graph=order_part, *args, **kwargs):
    return lambda spark, sf: getattr(graph(spark, sf), method)(*args, **kwargs)


def _dag(spark, sf):
    return part_next(spark, sf, acyclic=True)


def _excluded(g):
    """A view: edges of weight 50 go, then every part whose key is a multiple of 7, then branch 3."""
    g = g.without_edges(g.all_edges.where("weight = 50").select("edge_id"))
    g = g.without_nodes(g.nodes.where("node_id % 2 = 1 and ((node_id - 1) / 2) % 7 = 0"))
    return g.without_branches(g.all_edges.where("branch_id = 3").select("branch_id").limit(1))


def _sizes(spark, sf):
    g, d = order_part(spark, sf), part_next(spark, sf)
    row = [(name, x.node_count(), x.edge_count(), x.is_multigraph()) for name, x in (("order_part", g), ("part_next", d))]
    return spark.createDataFrame(row, "graph string, nodes long, edges long, multigraph boolean")


def _what_if(spark, sf):
    """Components without each edge in turn."""
    return components_without_each_edge(order_part(spark, sf))


def _members(spark, sf):
    out = _excluded(order_part(spark, sf)).connected_components_with_branch_ids()
    kind = F.when(F.col("branch_id").isNull(), "node").otherwise("branch")
    return out.select("component_id", kind.alias("kind"), F.coalesce("node_id", "branch_id").alias("member"))


def _score_rows(spark, sf):
    data = samples(spark, sf)
    families = [(c, ps) for c in K2_CARDS for ps in [(), *[(p,) for p in K2_CARDS if p != c]]]
    scores = bayes.local_scores(data, K2_CARDS, families)
    return spark.createDataFrame([(c, ",".join(p), round(s, 4)) for (c, p), s in scores.items()], "child string, parents string, score double")


def _edge_indices(spark, sf):
    """The edges of every pair of neighbours, asked for from the target to the source."""
    g = order_part(spark, sf)
    return g.edge_indices_between(g.edges.select(F.col("dst").alias("u"), F.col("src").alias("v")).distinct())


def _cycle_sizes(spark, sf):
    """Cycles of a basis, and edges that close one."""
    out = order_part(spark, sf).cycle_basis()
    return out.agg(F.countDistinct("cycle_id").alias("cycles"), F.count(F.when(F.col("position") == 0, 1)).alias("starts"))


def _cpds(spark, sf):
    out = bayes.estimate_cpds(samples(spark, sf), K2_CARDS, [("returnflag", "linestatus"), ("linenumber", "quantity")])
    return out.select("variable", "parent_config", "child_value", F.round("probability", 9).alias("probability"))


QUERIES = {
    "degree": _op("degree"),
    "neighbors": _op("neighbors"),
    "incident_edge_indices": _op("incident_edge_indices"),
    "edge_indices": _edge_indices,
    "out_degree": _op("out_degree", part_next),
    "in_degree": _op("in_degree", part_next),
    "successors": _op("successors", part_next),
    "predecessors": _op("predecessors", part_next),
    "outgoing_edge_indices": _op("outgoing_edge_indices", part_next),
    "incoming_edge_indices": _op("incoming_edge_indices", part_next),
    "graph_sizes": _sizes,
    "view_degree": lambda spark, sf: _excluded(order_part(spark, sf)).degree(),
    "view_components": lambda spark, sf: _excluded(order_part(spark, sf)).connected_components(),
    "view_split_node": lambda spark, sf: (g := order_part(spark, sf)).split_node(0, -2, g.all_edges.where("src = 0 and dst % 4 = 1").select("edge_id")).degree(),
    "view_with_edges": lambda spark, sf: order_part(spark, sf).with_edges([(0, -4), (-4, -6), (0, 0)]).degree(),
    "connected_components": _op("connected_components"),
    "components_with_branches": _members,
    "weakly_connected_components": _op("weakly_connected_components", part_next),
    "strongly_connected_components": _op("strongly_connected_components", part_next),
    "bfs": lambda spark, sf: order_part(spark, sf).bfs(0).select("node_id", "level"),
    "shortest_path_lengths": _op("shortest_path_lengths", order_part, 0),
    "shortest_path_lengths_cutoff": _op("shortest_path_lengths", order_part, 0, cutoff=20.0),
    "multi_source_lengths": _op("multi_source_shortest_path_lengths", order_part, [0, 2, 4]),
    "eccentricity": _op("eccentricity", order_part, 0),
    "shortest_path": lambda spark, sf: order_part(spark, sf).shortest_path(0, 201).agg(F.max("distance").alias("distance"), (F.count(F.lit(1)) - 1).alias("hops")),
    "bridges": _op("bridges"),
    "bridges_with_branch_ids": _op("bridges_with_branch_ids"),
    "articulation_points": _op("articulation_points"),
    "biconnected_components": _op("biconnected_components"),
    "two_edge_connected_components": _op("two_edge_connected_components"),
    "cycle_basis": _op("cycle_basis"),
    "cycle_basis_size": _cycle_sizes,
    "nodes_on_simple_paths": _op("nodes_on_simple_paths", order_part, 0, [201, 203]),
    "all_edge_paths": lambda spark, sf: (g := order_part(spark, sf)).all_edge_paths(0, g.nodes.where("node_id % 2 = 0"), cutoff=2).select(F.array_join("path", ",").alias("path")),
    "topological_sort": _op("topological_sort", _dag),
    "dag_longest_path": lambda spark, sf: _dag(spark, sf).dag_longest_path(unit=True).agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("nodes")),
    "for_each_edge_excluded": _what_if,
    "state_counts": lambda spark, sf: bayes.state_counts(samples(spark, sf), K2_CARDS, "quantity", ["returnflag", "linenumber"]),
    "k2_local_scores": _score_rows,
    "hill_climb_k2": lambda spark, sf: bayes.hill_climb_k2(dependent_samples(spark, sf), DEPENDENT_CARDS, max_indegree=2),
    "estimate_cpds": _cpds,
}

_LINES = f"""l AS MATERIALIZED (SELECT *, l_orderkey::BIGINT * {ID_STEP} + row_number() OVER w - 1 AS edge_id, lead(l_partkey) OVER w AS next FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(PLACES)}))"""
_EDGES = f"""{_LINES},
  e AS MATERIALIZED (SELECT edge_id, l_orderkey::BIGINT * 2 AS src, l_partkey::BIGINT * 2 + 1 AS dst, l_suppkey::BIGINT AS branch_id, l_quantity::DOUBLE AS weight FROM l),
  v AS MATERIALIZED (SELECT o_orderkey::BIGINT * 2 AS node_id FROM orders UNION SELECT p_partkey::BIGINT * 2 + 1 FROM part UNION SELECT src FROM e UNION SELECT dst FROM e)"""
_NEXT = f"""{_LINES},
  e AS MATERIALIZED (SELECT edge_id, l_partkey::BIGINT AS src, next::BIGINT AS dst FROM l WHERE next IS NOT NULL), v AS MATERIALIZED (SELECT src AS node_id FROM e UNION SELECT dst FROM e)"""
_DAG = f"""{_LINES},
  e AS MATERIALIZED (SELECT edge_id, least(l_partkey, next)::BIGINT AS src, greatest(l_partkey, next)::BIGINT AS dst FROM l WHERE next <> l_partkey), v AS MATERIALIZED (SELECT src AS node_id FROM e UNION SELECT dst FROM e)"""
_VIEW = f"""{_EDGES}, gone AS (SELECT node_id FROM v WHERE node_id % 2 = 1 AND ((node_id - 1) // 2) % 7 = 0),
  raw AS (SELECT * FROM e WHERE weight <> 50 AND branch_id <> 3), kept AS (SELECT node_id FROM v EXCEPT SELECT node_id FROM gone),
  live AS (SELECT * FROM raw WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone))"""
_BOTH = "b AS (SELECT src AS x, dst AS y, edge_id, weight FROM e UNION ALL SELECT dst, src, edge_id, weight FROM e)"


def _labels(nodes: str, edges: str, name: str = "lab") -> str:
    return f"""{name}(node_id, c) USING KEY (node_id) AS (SELECT node_id, node_id FROM {nodes} UNION
    (SELECT d.y, min(l.c) FROM {name} l JOIN (SELECT src AS x, dst AS y FROM {edges} UNION ALL SELECT dst, src FROM {edges}) d ON d.x = l.node_id
     JOIN recurring.{name} r ON r.node_id = d.y WHERE l.c < r.c GROUP BY d.y))"""


def _reach(sources: str, cutoff: str = "true") -> str:
    return f"""dist(node_id, d) USING KEY (node_id) AS (SELECT node_id, 0.0::DOUBLE FROM v WHERE node_id IN ({sources}) UNION
    (SELECT b.y, min(l.d + b.weight) FROM dist l JOIN b ON b.x = l.node_id LEFT JOIN recurring.dist r ON r.node_id = b.y
     WHERE (r.d IS NULL OR l.d + b.weight < r.d) AND ({cutoff}) GROUP BY b.y))"""


def _degree(nodes: str, ends: str) -> str:
    return f"SELECT n.node_id, count(x.node_id)::BIGINT AS degree FROM {nodes} n LEFT JOIN ({ends}) x ON x.node_id = n.node_id GROUP BY n.node_id"


_ENDS = "SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e"
_FLAG, _STATUS = "instr('ANR', l_returnflag) - 1", "instr('FO', l_linestatus) - 1"
_SAMPLES = f"""s AS (SELECT ({_FLAG})::BIGINT AS returnflag, ({_STATUS})::BIGINT AS linestatus, (l_linenumber - 1)::BIGINT AS linenumber,
  floor((l_quantity - 1) / 10)::BIGINT AS quantity FROM lineitem)"""


def _k2(child: str, parent: str | None) -> str:
    by = parent or "0"
    r = K2_CARDS[child]
    return f"""SELECT '{child}' AS child, '{parent or ""}' AS parents, round(sum(lgamma({r}) + a - lgamma(n + {r})), 4)::DOUBLE AS score FROM
      (SELECT j, sum(n) AS n, sum(lgamma(n + 1)) AS a FROM (SELECT {by} AS j, {child} AS k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY j)"""


def _cpd(v: str, parent: str | None) -> str:
    q, r = K2_CARDS[parent] if parent else 1, K2_CARDS[v]
    return f"""SELECT '{v}' AS variable, j AS parent_config, k AS child_value, round((count(s.{v}) FILTER (s.{v} = k) + 1)::DOUBLE / (count(s.{v}) + {r}), 9)::DOUBLE AS probability
      FROM range({q}) a(j) CROSS JOIN range({r}) b(k) LEFT JOIN s ON {f"s.{parent} = j" if parent else "true"} GROUP BY j, k"""


_UNIT = "b AS MATERIALIZED (SELECT src AS x, dst AS y, edge_id, 1.0 AS weight FROM e UNION ALL SELECT dst, src, edge_id, 1.0 FROM e)"
#: Blocks by their definition: each edge outside a breadth-first tree joins the tree edges, named by their lower nodes, of the cycle that it closes.
_BLOCKS = f"""{_EDGES}, {_UNIT}, {_labels("v", "e")}, {_reach("SELECT node_id FROM lab WHERE c = node_id")},
  par AS MATERIALIZED (SELECT b.x AS node, arg_min(b.y, b.edge_id) AS parent, min(b.edge_id) AS rise FROM b JOIN dist p ON p.node_id = b.x JOIN dist q ON q.node_id = b.y WHERE q.d = p.d - 1 GROUP BY b.x),
  anc AS (SELECT node, node AS a FROM par UNION ALL SELECT anc.node, q.node FROM anc JOIN par p ON p.node = anc.a JOIN par q ON q.node = p.parent),
  off AS MATERIALIZED (SELECT edge_id, src, dst FROM e WHERE src <> dst AND edge_id NOT IN (SELECT rise FROM par)),
  path AS MATERIALIZED (SELECT edge_id, a FROM (SELECT edge_id, a FROM off JOIN anc ON node = src UNION ALL SELECT edge_id, a FROM off JOIN anc ON node = dst) GROUP BY edge_id, a HAVING count(*) = 1),
  ties AS MATERIALIZED (SELECT DISTINCT min(a) OVER (PARTITION BY edge_id) AS src, a AS dst FROM path),
  {_labels("(SELECT node AS node_id FROM par)", "ties", "grp")},
  named AS (SELECT rise AS edge_id, c FROM par JOIN grp ON node_id = node UNION ALL SELECT edge_id, min(c) FROM path JOIN grp ON node_id = a GROUP BY edge_id),
  blk AS MATERIALIZED (SELECT edge_id, min(edge_id) OVER (PARTITION BY c) AS block_id FROM named),
  ends AS MATERIALIZED (SELECT DISTINCT block_id, unnest([src, dst]) AS node_id FROM blk JOIN e USING (edge_id)),
  cut AS MATERIALIZED (SELECT block_id AS edge_id FROM blk GROUP BY block_id HAVING count(*) = 1)"""
#: Pairs of nodes of which the second can be reached from the first.
_CLOSED = f"{_NEXT}, r AS (SELECT node_id AS a, node_id AS z FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.z)"

ORACLES = {
    "degree": f"WITH {_EDGES} {_degree('v', _ENDS)}",
    "neighbors": f"WITH {_EDGES} SELECT src AS node_id, dst AS neighbor FROM e UNION SELECT dst, src FROM e",
    "incident_edge_indices": f"WITH {_EDGES} SELECT src AS node_id, edge_id FROM e UNION SELECT dst, edge_id FROM e",
    "edge_indices": f"WITH {_EDGES} SELECT dst AS u, src AS v, edge_id FROM e",
    "out_degree": f"WITH {_NEXT} {_degree('v', 'SELECT src AS node_id FROM e')}",
    "in_degree": f"WITH {_NEXT} {_degree('v', 'SELECT dst AS node_id FROM e')}",
    "successors": f"WITH {_NEXT} SELECT DISTINCT src AS node_id, dst AS neighbor FROM e WHERE src <> dst",
    "predecessors": f"WITH {_NEXT} SELECT DISTINCT dst AS node_id, src AS neighbor FROM e WHERE src <> dst",
    "outgoing_edge_indices": f"WITH {_NEXT} SELECT src AS node_id, edge_id FROM e",
    "incoming_edge_indices": f"WITH {_NEXT} SELECT dst AS node_id, edge_id FROM e",
    "graph_sizes": f"""SELECT * FROM (WITH {_EDGES} SELECT 'order_part' AS graph, (SELECT count(*) FROM v)::BIGINT AS nodes, (SELECT count(*) FROM e)::BIGINT AS edges,
        EXISTS (SELECT 1 FROM e GROUP BY src, dst HAVING count(*) > 1) AS multigraph)
      UNION ALL SELECT * FROM (WITH {_NEXT} SELECT 'part_next', (SELECT count(*) FROM v)::BIGINT, (SELECT count(*) FROM e)::BIGINT, EXISTS (SELECT 1 FROM e GROUP BY src, dst HAVING count(*) > 1))""",
    "view_degree": f"WITH {_VIEW} {_degree('kept', 'SELECT src AS node_id FROM live UNION ALL SELECT dst FROM live')}",
    "view_components": f"WITH RECURSIVE {_VIEW}, {_labels('kept', 'live')} SELECT node_id, c AS component_id FROM lab",
    "view_split_node": f"""WITH {_EDGES} {_degree("(SELECT node_id FROM v UNION SELECT -2)", "SELECT CASE WHEN src = 0 AND dst % 4 = 1 THEN -2 ELSE src END AS node_id FROM e UNION ALL SELECT dst FROM e")}""",
    "view_with_edges": f"""WITH {_EDGES} {_degree("(SELECT node_id FROM v UNION SELECT -4 UNION SELECT -6)", _ENDS + " UNION ALL SELECT unnest([0, -4, -4, -6, 0, 0])")}""",
    "connected_components": f"WITH RECURSIVE {_EDGES}, {_labels('v', 'e')} SELECT node_id, c AS component_id FROM lab",
    "components_with_branches": f"""WITH RECURSIVE {_VIEW}, {_labels('kept', 'live')} SELECT c AS component_id, 'node' AS kind, node_id AS member FROM lab
      UNION ALL (SELECT DISTINCT coalesce(a.c, b.c, raw.dst), 'branch', branch_id FROM raw LEFT JOIN lab a ON a.node_id = src LEFT JOIN lab b ON b.node_id = dst)""",
    "weakly_connected_components": f"WITH RECURSIVE {_NEXT}, {_labels('v', 'e')} SELECT node_id, c AS component_id FROM lab",
    "bfs": f"""WITH RECURSIVE {_EDGES}, {_UNIT}, {_reach("0")} SELECT node_id, d::BIGINT AS level FROM dist""",
    "shortest_path_lengths": f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('0')} SELECT node_id, d AS distance FROM dist",
    "shortest_path_lengths_cutoff": f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('0', 'l.d + b.weight <= 20')} SELECT node_id, d AS distance FROM dist",
    "multi_source_lengths": f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('0, 2, 4')} SELECT node_id, d AS distance FROM dist",
    "eccentricity": f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('0')} SELECT max(d) AS eccentricity FROM dist",
    "all_edge_paths": f"WITH {_EDGES} SELECT a.edge_id || ',' || z.edge_id AS path FROM e a JOIN e z ON z.dst = a.dst AND z.edge_id <> a.edge_id WHERE a.src = 0",
    "shortest_path": f"""WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('0')},
      tight AS MATERIALIZED (SELECT b.x, b.y FROM b JOIN dist p ON p.node_id = b.x JOIN dist q ON q.node_id = b.y WHERE p.d + b.weight = q.d),
      hop(node_id, h) USING KEY (node_id) AS (SELECT 0::BIGINT, 0::BIGINT UNION (SELECT t.y, min(hop.h) + 1 FROM hop JOIN tight t ON t.x = hop.node_id LEFT JOIN recurring.hop r ON r.node_id = t.y
        WHERE r.h IS NULL OR hop.h + 1 < r.h GROUP BY t.y))
      SELECT d AS distance, h AS hops FROM dist JOIN hop USING (node_id) WHERE node_id = 201""",
    "strongly_connected_components": f"WITH RECURSIVE {_CLOSED} SELECT r.a AS node_id, min(r.z) AS scc_id FROM r JOIN r back ON back.a = r.z AND back.z = r.a GROUP BY r.a",
    "biconnected_components": f"WITH RECURSIVE {_BLOCKS} SELECT block_id, node_id FROM ends",
    "articulation_points": f"WITH RECURSIVE {_BLOCKS} SELECT node_id FROM ends GROUP BY node_id HAVING count(*) > 1",
    "bridges": f"WITH RECURSIVE {_BLOCKS} SELECT edge_id, src, dst, branch_id FROM e JOIN cut USING (edge_id)",
    "bridges_with_branch_ids": f"WITH RECURSIVE {_BLOCKS} SELECT src, dst, branch_id FROM e JOIN cut USING (edge_id)",
    "two_edge_connected_components": f"WITH RECURSIVE {_BLOCKS}, firm AS MATERIALIZED (SELECT src, dst FROM e WHERE edge_id NOT IN (SELECT edge_id FROM cut)), {_labels('v', 'firm', 'tec')} SELECT node_id, c AS component_id FROM tec",
    "for_each_edge_excluded": f"""WITH RECURSIVE {_BLOCKS} SELECT edge_id, ((SELECT count(DISTINCT c) FROM lab) + CASE WHEN cut.edge_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_components
      FROM e LEFT JOIN cut USING (edge_id)""",
    "nodes_on_simple_paths": f"""WITH RECURSIVE {_BLOCKS} SELECT DISTINCT node_id FROM ends WHERE block_id IN
      (SELECT block_id FROM anc JOIN par ON par.node = a JOIN blk ON edge_id = rise WHERE anc.node IN (SELECT node_id FROM lab WHERE node_id IN (201, 203) AND c = 0))""",
    "cycle_basis_size": f"""WITH RECURSIVE {_EDGES}, {_labels("v", "e")} SELECT n AS cycles, n AS starts FROM
      (SELECT ((SELECT count(*) FROM e) - (SELECT count(*) FROM v) + (SELECT count(DISTINCT c) FROM lab))::BIGINT AS n)""",
    "topological_sort": f"""WITH RECURSIVE {_DAG}, lv(node_id, l) USING KEY (node_id) AS (SELECT node_id, 0::BIGINT FROM v UNION
      (SELECT e.dst, max(lv.l) + 1 FROM lv JOIN e ON e.src = lv.node_id JOIN recurring.lv r ON r.node_id = e.dst WHERE lv.l + 1 > r.l GROUP BY e.dst))
      SELECT node_id, l AS level FROM lv""",
    "dag_longest_path": f"""WITH RECURSIVE {_DAG}, lv(node_id, l) USING KEY (node_id) AS (SELECT node_id, 0::BIGINT FROM v UNION
      (SELECT e.dst, max(lv.l) + 1 FROM lv JOIN e ON e.src = lv.node_id JOIN recurring.lv r ON r.node_id = e.dst WHERE lv.l + 1 > r.l GROUP BY e.dst))
      SELECT max(l)::DOUBLE AS length, (max(l) + 1)::BIGINT AS nodes FROM lv""",
    "state_counts": f"WITH {_SAMPLES} SELECT returnflag * 7 + linenumber AS parent_config, quantity AS child_value, count(*)::BIGINT AS n FROM s GROUP BY 1, 2",
    "k2_local_scores": f"WITH {_SAMPLES} " + " UNION ALL ".join(_k2(c, p) for c in K2_CARDS for p in [None, *[x for x in K2_CARDS if x != c]]),
    "estimate_cpds": f"WITH {_SAMPLES} " + " UNION ALL ".join(_cpd(v, {"linestatus": "returnflag", "quantity": "linenumber"}.get(v)) for v in K2_CARDS),
}
