"""Structure operators as loops of joins, for components that no task can take. Results equal those of the kernels.

Undirected forms stand on a breadth-first forest, built level by level from the smallest node of each component, so
rounds grow with its depth. Blocks follow Tarjan and Vishkin: preorder numbers and subtree sizes tell which tree
edges (named by their lower node) share a cycle, and the components of those relations are the blocks. Inputs are
rows (component_id, edge_id, src, dst); all state between rounds is in written tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import Bucketed, bucketed, buckets, discard, materialize
from . import waves
from .labels import join_hot, label_components

#: Levels of a forest up to which each node gets its path to the root.
MOST_LEVELS = 24


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _forest(rows: DataFrame, ranked: bool) -> tuple[DataFrame, int]:
    """(node, level, rank, parent, by) in buckets by node, and how many levels; ``by`` is the edge to the parent.

    ``ranked``: nodes are visited in the kernels' order; else the smallest edge to the level above decides.
    """
    e = rows.where("src <> dst")
    n = buckets(2 * e.count())
    ahead = e.select(F.col("src").alias("at"), F.col("dst").alias("node"), "edge_id").union(e.select("dst", "src", "edge_id"))
    return waves.forest(rows.select(F.col("component_id").alias("node")).distinct(), bucketed(ahead, "at", n, "ahead"), n, ranked)


def _numbered(levels: list[DataFrame]) -> list[DataFrame]:
    """The levels as (node, parent, by, size, pre): nodes of the subtree, and preorder numbers within the tree."""
    sized: list[DataFrame] = []
    for level in reversed(levels):
        own = level.select("node", "parent", "by")
        if sized:
            below = sized[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
            own = own.join(below, "node", "left").select("node", "parent", "by", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
        else:
            own = own.withColumn("size", F.lit(1).cast("long"))
        sized.append(materialize(own, "sized"))
    sized.reverse()
    out = [sized[0].withColumn("pre", F.lit(0).cast("long"))]
    before = F.sum("size").over(W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    for level in sized[1:]:
        above = out[-1].select(F.col("node").alias("parent"), F.col("pre").alias("start"))
        placed = level.withColumn("before", F.coalesce(before, F.lit(0))).join(above, "parent")
        out.append(materialize(placed.select("node", "parent", "by", "size", (F.col("start") + 1 + F.col("before")).alias("pre")), "numbered"))
    return out


def _grouped(rows: DataFrame) -> DataFrame:
    """(edge_id, g): edges share g where they share a block. Loops are in none."""
    rows = materialize(rows.select("component_id", "edge_id", "src", "dst"), "large")
    found, deep = _forest(rows, ranked=False)
    levels = _numbered([found.where(F.col("level") == k).select("node", "parent", "by") for k in range(deep)])
    every = materialize(_union(levels), "preorder")
    number = lambda c: every.select(F.col("node").alias(c), F.col("pre").alias(f"{c}_pre"), F.col("size").alias(f"{c}_size"))
    off = rows.where("src <> dst").join(every.where("by is not null").select(F.col("by").alias("edge_id")), "edge_id", "left_anti")
    off = materialize(off.join(number("src"), "src").join(number("dst"), "dst"), "off")
    ends = off.select(F.col("src").alias("node"), F.col("dst_pre").alias("to")).union(off.select("dst", "src_pre"))
    reach = materialize(ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi")), "reach")
    spans: list[DataFrame] = []
    for level in reversed(levels):
        own = level.join(reach, "node", "left")
        lows, highs = ["pre", "lo"], ["pre", "hi"]
        if spans:
            below = spans[-1].groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("kids_lo"), F.max("high").alias("kids_hi"))
            own, lows, highs = own.join(below, "node", "left"), [*lows, "kids_lo"], [*highs, "kids_hi"]
        # least and greatest skip nulls
        spans.append(materialize(own.select("node", "parent", "by", "size", "pre", F.least(*lows).alias("low"), F.greatest(*highs).alias("high")), "span"))
    tree = materialize(_union(spans).where("parent is not null"), "tree")
    above = tree.select(F.col("node").alias("parent"), F.col("pre").alias("p"), F.col("size").alias("n"))
    leaves = tree.join(above, "parent").where("low < p or high >= p + n").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    apart = off.where("least(src_pre + src_size, dst_pre + dst_size) <= greatest(src_pre, dst_pre)").select("src", "dst")
    groups = label_components(materialize(leaves.union(apart), "together"))
    at = tree.select(F.col("by").alias("edge_id"), F.col("node").alias("node_id"))
    at = at.union(off.select("edge_id", F.when(F.col("src_pre") > F.col("dst_pre"), F.col("src")).otherwise(F.col("dst"))))
    named = at.join(groups, "node_id", "left").select("edge_id", F.coalesce("component_id", "node_id").alias("g"))
    return materialize(named, "named")


def blocks(rows: DataFrame) -> DataFrame:
    """(block_id, edge_id): biconnected components by edges; block_id is the smallest edge id. Loops are in none."""
    named = _grouped(rows)
    least = materialize(named.groupBy("g").agg(F.min("edge_id").alias("block_id")), "least")
    return join_hot(named, least, "g").select("block_id", "edge_id")  # one block may hold nearly all edges


def bridges(rows: DataFrame) -> DataFrame:
    """(edge_id) of blocks of a single edge."""
    one = _grouped(rows).groupBy("g").agg(F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("n"))
    return one.where("n = 1").select("edge_id")


def cycle_basis(rows: DataFrame) -> DataFrame:
    """(cycle_id, position, node_id): both ends of each edge outside the forest climb, one step a round, until they meet."""
    rows = materialize(rows.select("component_id", "edge_id", "src", "dst"), "large")
    up, deep = _forest(rows, ranked=True)
    off = rows.join(up.where("by is not null").select(F.col("by").alias("edge_id")), "edge_id", "left_anti")
    if deep <= MOST_LEVELS:
        return _by_paths(off, up, deep)
    height = lambda c, as_: up.select(F.col("node").alias(c), F.col("level").alias(as_))
    one = F.lit(1).cast("long")
    # a, b: the nodes reached from either end; n, m: how many nodes each side has, the meeting one counted twice
    now = off.join(height("src", "a_level"), "src").join(height("dst", "b_level"), "dst")
    now = materialize(now.select(F.col("edge_id").alias("cycle_id"), F.col("src").alias("a"), F.col("dst").alias("b"), "a_level", "b_level", one.alias("n"), one.alias("m")), "climb")
    left, right, met = [now.select("cycle_id", (F.col("n") - 1).alias("position"), F.col("a").alias("node_id"))], [now.select("cycle_id", "m", F.col("b").alias("node_id"))], []
    while True:
        met.append(now.where("a = b").select("cycle_id", "n", F.col("m").alias("last")))
        open_ = now.where("a <> b").withColumn("first", F.col("a_level") >= F.col("b_level"))
        open_ = open_.withColumn("node", F.when(F.col("first"), F.col("a")).otherwise(F.col("b")))
        step = open_.join(up.select("node", "parent"), "node")
        pick = lambda own, moved, mine: F.when(F.col("first") if mine else ~F.col("first"), moved).otherwise(F.col(own)).alias(own)
        sides = [pick("a", F.col("parent"), True), pick("b", F.col("parent"), False), pick("a_level", F.col("a_level") - 1, True), pick("b_level", F.col("b_level") - 1, False)]
        now = materialize(step.select("cycle_id", *sides, pick("n", F.col("n") + 1, True), pick("m", F.col("m") + 1, False), "first"), "climb")
        if now.isEmpty():
            break
        left.append(now.where("first").select("cycle_id", (F.col("n") - 1).alias("position"), F.col("a").alias("node_id")))
        right.append(now.where("not first").select("cycle_id", "m", F.col("b").alias("node_id")))
    # the right side is told from the meeting node down, without that node itself
    back = _union(right).join(_union(met), "cycle_id").where("m < last")
    return _union(left).union(back.select("cycle_id", F.col("n") + F.col("last") - 1 - F.col("m"), "node_id"))


def _by_paths(off: DataFrame, up: DataFrame, deep: int) -> DataFrame:
    """The cycles of the edges ``off`` a shallow forest, from the paths of both ends to the root."""
    n = buckets(up.count())
    paths = Bucketed(up.sparkSession, "node", n, "paths")
    paths.add(up.where("level = 0").select("node", "level", F.array("node").alias("path")))
    for k in range(1, deep):
        above = paths.read().where(F.col("level") == k - 1).select(F.col("node").alias("parent"), F.col("path").alias("rest"))
        level = up.where(F.col("level") == k).select("node", "level", "parent").join(above, "parent")
        paths.add(level.select("node", "level", F.concat(F.array("node"), "rest").alias("path")))
    found = paths.done()
    end = lambda c: found.select(F.col("node").alias(c), F.col("path").alias(f"{c}_path"))
    both = off.select(F.col("edge_id").alias("cycle_id"), "src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    shared = F.size(F.array_intersect("src_path", "dst_path"))
    left = F.slice("src_path", F.lit(1), F.size("src_path") - shared + 1)
    right = F.reverse(F.slice("dst_path", F.lit(1), F.size("dst_path") - shared))
    rows = both.select("cycle_id", F.posexplode(F.concat(left, right)).alias("position", "node_id"))
    return rows.select("cycle_id", F.col("position").cast("long").alias("position"), "node_id")


def strong_components(rows: DataFrame) -> DataFrame:
    """(node_id, scc_id) of strong components of two nodes or more: the smallest node.

    Edges that can lie on no cycle are trimmed; the smallest node that reaches each node colours it, and what reaches
    that node back within its colour is its component. The rest goes on within its colours.
    """
    left = materialize(rows.where("src <> dst").select("src", "dst").distinct(), "left")
    found = [rows.sparkSession.createDataFrame([], "node_id long, scc_id long")]
    while True:
        n = left.count()
        while n:
            ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            kept = materialize(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "left")
            discard(left)
            left, before, n = kept, n, kept.count()
            if n == before:
                break
        if not n:
            return _union(found)
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = materialize(nodes.select("node", F.col("node").alias("c"), F.lit(True).alias("new")), "colour")
        while not colour.where("new").isEmpty():
            step = left.join(colour.where("new").select(F.col("node").alias("src"), F.col("c").alias("d")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("d").alias("d"))
            better = F.coalesce(F.col("d") < F.col("c"), F.lit(False))
            after = materialize(colour.join(step, "node", "left").select("node", F.least("c", "d").alias("c"), better.alias("new")), "colour")
            discard(colour)
            colour = after
        of = lambda end: colour.select(F.col("node").alias(end), F.col("c").alias(f"{end}_c"))
        inner = left.join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c")
        inner = materialize(inner.select("src", "dst", F.col("src_c").alias("c")), "inner")
        front = done = materialize(colour.where("node = c").select("node", "c"), "back")
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            front = materialize(back.join(done.select("node"), "node", "left_anti"), "front")
            done = materialize(done.union(front), "back")
        found.append(done.select(F.col("node").alias("node_id"), F.col("c").alias("scc_id")))
        gone = done.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        after = materialize(rest.select("src", "dst"), "left")
        for old in (left, colour, inner):
            discard(old)
        left = after
