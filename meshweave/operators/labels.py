"""Connected components of an edge table by contraction: hook, jump, relabel, until one task can take what is left."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize
from . import kernels

#: Rows of one key above which they are joined where they stand.
HOT_ROWS = 100_000


def join_hot(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` left join ``one``, which has a row for a key at most, where a key may hold nearly all rows.

    The rows of keys with over ``HOT_ROWS`` stay where they are and get their side by broadcast, which has at most
    a row for each ``HOT_ROWS``; only the others are shuffled.
    """
    hot = materialize(many.groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key), "hot")
    if hot.isEmpty():
        return many.join(one, key, "left")
    side = materialize(hot.join(one, key, "left"), "hot")
    few = many.join(F.broadcast(hot), key, "left_anti").join(one, key, "left")
    return few.unionByName(many.join(F.broadcast(side), key))


def _jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the root of its chain; chains halve each time, and rows that reach a root rest."""
    done, active = None, parents
    while True:
        every = active if done is None else done.union(active)
        up = every.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        joined = join_hot(active, up, "parent")
        after = materialize(joined.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump")
        rest, active = after.where("not moved").drop("moved"), after.where("moved").drop("moved")
        done = rest if done is None else done.union(rest)
        if active.isEmpty():
            return done


def _rest(batches):
    """The smallest node of its component for each end of rows (a, b)."""
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        ids, (a, b) = kernels.local_ids(*(table.column(c).to_numpy() for c in "ab"))
        root = kernels.union_labels(len(ids), a, b)
        at = np.flatnonzero(root != np.arange(len(ids)))
        yield from pa.table([pa.array(ids[at]), pa.array(ids[root[at]])], names=["node", "root"]).to_batches()


def label_components(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(src, dst) longs to (node_id, component_id): the smallest node that each endpoint can reach; none for that node itself.

    ``edges`` must be a written table. Each round every node hooks to its smallest smaller neighbour (combined before the
    shuffle), chains are jumped to their roots, and edges are relabelled by root and made distinct, so a hub's edges
    collapse in the round in which it is reached. Up to ``most`` edges one task ends it. Rounds grow with the logarithm
    of the nodes. Each round keeps its own hooks; labels are put together backwards at the end, so no round touches
    the labels of all nodes. The driver only asks how many edges are left.
    """
    left, old = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), None
    rounds: list[DataFrame] = []
    while (n := left.count()) > most:
        roots = _jump(materialize(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks"))
        rounds.append(roots)
        to = lambda c: roots.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_"))  # noqa: B023, E731
        ends = left.join(to("b"), "b").join(to("a"), "a", "left").select(F.coalesce("a_", "a").alias("x"), F.col("b_").alias("y"))
        after = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old)
        left = old = after
    if n:
        labels = materialize(left.repartition(1).mapInArrow(_rest, "node long, root long"), "labels")
    else:
        labels = edges.sparkSession.createDataFrame([], "node long, root long")
    for hooks in reversed(rounds):
        named = join_hot(hooks, labels.select(F.col("node").alias("parent"), "root"), "parent")
        labels = materialize(labels.union(named.select("node", F.coalesce("root", "parent").alias("root"))), "labels")
    return labels.select(F.col("node").alias("node_id"), F.col("root").alias("component_id"))
