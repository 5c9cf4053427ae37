"""Traversals as waves over edges that stand in buckets by their source, for graphs that no task can take.

A round joins the nodes that moved last to their edges; only what they send is shuffled, never the edges or the labels
of nodes that rest. All state between rounds is in written tables, added to and never written anew as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import Bucketed, bucketed, buckets, discard, materialize, new_path
from . import kernels

#: Rows of a wave up to which each executor gets all of it (two or three numbers a row).
SMALL_WAVE = 500_000


def _wave(front: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(front) if rows <= SMALL_WAVE else front.hint("shuffle_hash")


def distances(starts: DataFrame, ahead: DataFrame, n: int, step: float, cutoff: float | None) -> DataFrame:
    """(node_id, distance) of what the starts reach; ``ahead`` (src, dst, weight) stands in ``n`` buckets by src.

    Only nodes within ``step`` of the least distance that was not passed on yet move in a round, so that few nodes move
    twice. Each gain in distance is one row of a log; a node's distance is its least row.
    """
    log = Bucketed(starts.sparkSession, "node_id", n, "distances")
    log.add(starts.select("node_id", F.lit(0.0).alias("d"), F.lit(0).alias("round")))
    upto, last = float("-inf"), 0
    while True:
        # a smaller distance of a node is always a later one
        best = log.read().groupBy("node_id").agg(F.min(F.struct("d", "round")).alias("b")).select("node_id", "b.*")
        waits = best.where((F.col("d") > upto) | (F.col("round") == last))
        least, rows = waits.agg(F.min("d"), F.count(F.lit(1))).first()
        if least is None:
            log.done()
            return best.select("node_id", F.col("d").alias("distance"))
        upto = max(upto, least + step)
        front = waits.where(F.col("d") <= upto).select(F.col("node_id").alias("src"), "d")
        sent = ahead.join(_wave(front, rows), "src").select(F.col("dst").alias("node_id"), (F.col("d") + F.col("weight")).alias("c"))
        if cutoff is not None:
            sent = sent.where(F.col("c") <= cutoff)
        near = sent.groupBy("node_id").agg(F.min("c").alias("c")).join(best.select("node_id", "d"), "node_id", "left")
        last += 1
        log.add(near.where("d is null or c < d").select("node_id", F.col("c").alias("d"), F.lit(last).alias("round")), dealt=True)


def tight(found: DataFrame, into: DataFrame, target: int) -> DataFrame:
    """(src, dst, weight) of all edges on paths of least distance to the target, walked back from it.

    ``found`` (node_id, distance) and ``into`` (src, dst, weight) stand in buckets by node and dst.
    """
    ends = found.where(F.col("node_id") == target).select(F.col("node_id").alias("dst"), F.col("distance").alias("d"))
    front = seen = materialize(ends, "tight")
    out = None
    while m := front.count():
        back = into.join(_wave(front, m), "dst")
        told = found.select(F.col("node_id").alias("src"), F.col("distance").alias("from"))
        near = materialize(back.select("src", "dst", "weight", "d"), "near")
        few = near.count() <= SMALL_WAVE
        near = told.join(F.broadcast(near) if few else near, "src").where(F.col("from") + F.col("weight") == F.col("d"))
        near = materialize(near, "tight")
        out = near if out is None else materialize(out.union(near), "tight")
        new = near.select(F.col("src").alias("dst"), F.col("from").alias("d")).distinct().join(seen.select("dst"), "dst", "left_anti")
        front = materialize(new, "front")
        seen = seen.union(front)
    return out.select("src", "dst", "weight") if out is not None else into.where("false").select("src", "dst", "weight")


def order(nodes: DataFrame, edges: DataFrame, edge_count: int, most: int) -> tuple[DataFrame, int]:
    """(node_id, level, d, pred) in topological order, and how many nodes lie on or behind a cycle (these have no row).

    ``level``: the most edges that lead to the node; ``d``: the greatest length of a path that ends in it, 0 at least;
    ``pred``: the node before it on that path, by least (level, node). Each edge is sent once, when its source's last
    edge has come; when no more than ``most`` edges are left, one task does the rest.
    """
    n = buckets(edge_count)
    ahead = bucketed(edges.select("src", "dst", F.col("weight").cast("double")), "src", n, "ahead")
    ins = ahead.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("waits"))
    first = nodes.join(ins, "node_id", "left").select("node_id", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("pred"))
    state, path, k = bucketed(first, "node_id", n, "waits"), new_path(nodes.sparkSession, "levels"), 0
    while True:
        free, stuck, left = state.agg(F.count(F.when(F.col("waits") == 0, 1)), F.count(F.when(F.col("waits") > 0, 1)), F.coalesce(F.sum("waits"), F.lit(0))).first()
        if not free or 0 < left <= most:
            break
        front = state.where("waits = 0").select("node_id", F.lit(k).cast("long").alias("level"), "d", "pred")
        front.write.parquet(f"{path}/{k}")
        if not stuck:
            break
        front = nodes.sparkSession.read.schema(front.schema).parquet(f"{path}/{k}") if free <= SMALL_WAVE else front
        sent = ahead.join(_wave(front.select(F.col("node_id").alias("src"), "d"), free), "src")
        most_ = F.max(F.struct((F.col("d") + F.col("weight")).alias("d"), (-F.col("src")).alias("s"))).alias("m")
        sent = sent.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("came"), most_)
        both = state.where("waits > 0").join(sent, "node_id", "left")
        up = F.coalesce(F.col("m.d") > F.col("d"), F.lit(False))
        both = both.select("node_id", (F.col("waits") - F.coalesce("came", F.lit(0))).alias("waits"), F.when(up, F.col("m.d")).otherwise(F.col("d")).alias("d"), F.when(up, -F.col("m.s")).otherwise(F.col("pred")).alias("pred"))
        after = bucketed(both, "node_id", n, "waits", dealt=True)
        discard(state)
        state, k = after, k + 1
    if free:
        stuck = 0
    if free and left:
        none = lambda t: F.lit(None).cast(t)
        rest = ahead.join(state.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst", "weight", none("double").alias("d"), none("long").alias("pred"))
        rest = rest.union(state.select("node_id", none("long"), none("double"), "d", "pred")).repartition(1)
        done = materialize(rest.mapInArrow(_rest(k), "node_id long, level long, d double, pred long"), "rest")
        stuck = done.where("level < 0").count()
        done.write.parquet(f"{path}/{k}")
    schema = "node_id long, level long, d double, pred long"
    if not k and not free:
        return nodes.sparkSession.createDataFrame([], schema), stuck
    out = nodes.sparkSession.read.option("recursiveFileLookup", "true").schema(schema).parquet(path)
    return out.where("level >= 0"), stuck


def _rest(k: int):
    """Levels and lengths of nodes that wait at round ``k``: rows of edges, and of nodes (without dst) with what has come."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        edges, own = table.filter(pc.is_valid(table.column("dst"))), table.filter(pc.is_null(table.column("dst")))
        ids, (src, dst, node) = kernels.local_ids(*(t.column(c).to_numpy() for t, c in ((edges, "src"), (edges, "dst"), (own, "src"))))
        level = kernels.levels(len(ids), src, dst)
        start, before = np.zeros(len(ids)), np.full(len(ids), -1)
        start[node] = own.column("d").to_numpy()
        fit = np.flatnonzero((level[src] >= 0) & (level[dst] >= 0))
        d, back = kernels.lengths(src[fit], dst[fit], edges.column("weight").to_numpy()[fit], level, start)
        before[node] = pc.fill_null(own.column("pred"), -1).to_numpy()
        told = own.column("pred").is_valid().to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, bool)
        has = back >= 0
        known = np.zeros(len(ids), bool)
        known[node] = told
        before[has] = ids[back[has]]
        out = np.where(level < 0, -1, level + k)
        arrays = [pa.array(ids[node]), pa.array(out[node]), pa.array(d[node]), pa.array(before[node], mask=~(known | has)[node])]
        yield from pa.table(arrays, names=["node_id", "level", "d", "pred"]).to_batches()

    return run


def _ranks(found: DataFrame, rows: int, before: int) -> DataFrame:
    """``found`` (node, parent, by, after) with ``rank``: ``before`` and its place by (after, by), without one task that sorts all."""
    if rows <= SMALL_WAVE:
        return found.withColumn("rank", F.row_number().over(W.orderBy("after", "by")).cast("long") + (before - 1))
    dealt = found.repartitionByRange(buckets(rows), "after", "by").sortWithinPartitions("after", "by")
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    offsets, start = [], before
    for k, m in sorted(dealt.groupBy(part.alias("part")).count().collect()):  # a row for each task
        offsets.append((k, start - (k << 33)))
        start += m
    side = F.broadcast(found.sparkSession.createDataFrame(offsets, "part long, add long"))
    return dealt.withColumn("part", part).join(side, "part").withColumn("rank", F.col("at") + F.col("add"))


def forest(roots: DataFrame, ahead: DataFrame, n: int, ranked: bool) -> tuple[DataFrame, int]:
    """(node, level, rank, parent, by) in ``n`` buckets by node, breadth first from the roots (node), and how many levels there are.

    ``ahead`` (at, node, edge_id) stands in ``n`` buckets by at. ``ranked``: neighbours are visited by rank and then by
    edge, and ranks go on over levels; else ranks are 0 and the smallest edge to the level above decides.
    """
    log, none = Bucketed(roots.sparkSession, "node", n, "forest"), F.lit(None).cast("long")
    first = roots.select("node", none.alias("parent"), none.alias("by"), F.lit(0).cast("long").alias("after"))
    columns = "node", F.lit(0).cast("long").alias("level"), "rank", "parent", "by"
    m = roots.count()
    log.add((_ranks(first.withColumn("by", F.col("node")), m, 0).withColumn("by", none) if ranked else first.withColumn("rank", F.col("after"))).select(*columns))
    k, seen = 0, m
    while m:
        front = log.read().where(F.col("level") == k).select(F.col("node").alias("at"), "rank")
        sent = ahead.join(_wave(front, m), "at").groupBy("node").agg(F.min(F.struct("rank", "edge_id", "at")).alias("f"))
        new = sent.join(log.read().select("node"), "node", "left_anti")
        new = new.select("node", F.col("f.at").alias("parent"), F.col("f.edge_id").alias("by"), F.col("f.rank").alias("after"))
        k += 1
        columns = "node", F.lit(k).cast("long").alias("level"), "rank", "parent", "by"
        if ranked:
            new = materialize(new, "level")
            m = new.count()
            if m:
                log.add(_ranks(new, m, seen).select(*columns))
            discard(new)
            seen += m
        else:
            log.add(new.withColumn("rank", F.lit(0).cast("long")).select(*columns), dealt=True)
            m = log.read().where(F.col("level") == k).count()
    return log.done(), k
