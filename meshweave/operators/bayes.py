"""Bayesian-network structure learning on a table of discrete columns (values 0 .. cardinality-1).

Spark does all counting; what reaches the driver is one row for each observed combination of a family, whose number is
bounded by the product of its cardinalities, not by the data. Scores of a whole round of candidates come from one
pass with grouping sets.
"""

from __future__ import annotations

import math
import uuid
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(data: DataFrame, cards: dict[str, int]) -> None:
    """One aggregation: no value may lie outside its cardinality."""
    row = data.agg(*[F.max(c).alias(f"max_{c}") for c in cards], *[F.min(c).alias(f"min_{c}") for c in cards]).first()
    for c, card in cards.items():
        if row[f"max_{c}"] is not None and not 0 <= row[f"min_{c}"] <= row[f"max_{c}"] < card:
            raise ValueError(f"values of {c} lie outside 0..{card - 1}")


def config(cards: dict[str, int], parents: list[str]):
    """Mixed radix number of the parents' values; the last parent is fastest."""
    out = F.lit(0).cast("long")
    for p in parents:
        out = out * cards[p] + F.col(p)
    return out


def state_counts(data: DataFrame, cards: dict[str, int], child: str, parents: list[str]) -> DataFrame:
    """(parent_config, child_value, n) of observed combinations."""
    return data.groupBy(config(cards, parents).alias("parent_config"), F.col(child).cast("long").alias("child_value")).agg(F.count(F.lit(1)).alias("n"))


def _score(families: dict[tuple, dict[int, int]], r: int) -> float:
    """K2 over observed configurations; the others contribute nothing."""
    return math.fsum(math.lgamma(r) + math.fsum(math.lgamma(n + 1) for n in held.values()) - math.lgamma(sum(held.values()) + r) for _, held in sorted(families.items()))


def local_scores(data: DataFrame, cards: dict[str, int], wanted: list[tuple[str, tuple[str, ...]]]) -> dict[tuple[str, tuple[str, ...]], float]:
    """K2 local scores of (child, parents) families, all counted in one pass with grouping sets."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return {}
    families = list(dict.fromkeys(tuple(sorted({c, *ps})) for c, ps in wanted))
    columns = sorted({c for f in families for c in f})
    view = f"__meshweave_{uuid.uuid4().hex}"
    data.select(*columns).createOrReplaceTempView(view)
    sets = ", ".join("(" + ", ".join(f"`{c}`" for c in f) + ")" for f in families)
    names = ", ".join(f"`{c}`" for c in columns)
    counted = data.sparkSession.sql(f"SELECT {names}, grouping_id({names}) AS g, count(*) AS n FROM {view} GROUP BY {names} GROUPING SETS ({sets})" if len(families) > 1 or families[0] != tuple(columns) else f"SELECT {names}, 0 AS g, count(*) AS n FROM {view} GROUP BY {names}")
    groups = {sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in f): f for f in families}
    held: dict[tuple, list] = {f: [] for f in families}
    for row in counted.toLocalIterator():
        held[groups[int(row["g"])]].append(row)
    out = {}
    data.sparkSession.catalog.dropTempView(view)
    for child, parents in wanted:
        table: dict[tuple, dict[int, int]] = {}
        for row in held[tuple(sorted({child, *parents}))]:
            table.setdefault(tuple(row[p] for p in parents), {})[row[child]] = row["n"]
        out[child, parents] = _score(table, cards[child])
    return out


def k2_local_score(data: DataFrame, cards: dict[str, int], child: str, parents: list[str]) -> float:
    check(data, {c: cards[c] for c in (child, *parents)})
    return local_scores(data, cards, [(child, tuple(parents))])[child, tuple(parents)]


def hill_climb_k2(data: DataFrame, cards: dict[str, int], *, max_indegree: int = 1, tabu_length: int = 100, epsilon: float = 1e-4, max_iter: int = 1_000_000) -> DataFrame:
    """(parent, child) edges of a DAG by greedy additions, removals and flips with a tabu list.

    Candidates are tried as additions, removals, flips, each by ascending parent and child; the first best wins. The
    search stops when the best gain is below ``epsilon``.
    """
    spark, names = data.sparkSession, list(cards)
    schema = "parent string, child string"
    if len(names) < 2 or data.isEmpty():
        return spark.createDataFrame([], schema)
    check(data, cards)
    parents: dict[str, list[str]] = {v: [] for v in names}
    tabu: deque = deque(maxlen=max(0, tabu_length))
    known: dict[tuple, float] = {}

    def key(child, held):
        return child, tuple(sorted(held))

    def reaches(start, end, without=None) -> bool:
        seen, stack = {start}, [start]
        while stack:
            v = stack.pop()
            if v == end:
                return True
            for w in names:
                if v in parents[w] and (v, w) != without and w not in seen:
                    seen.add(w)
                    stack.append(w)
        return False

    for _ in range(max_iter):
        moves = []
        for u in names:
            for v in names:
                if u != v and u not in parents[v] and v not in parents[u] and len(parents[v]) < max_indegree and ("add", u, v) not in tabu and not reaches(v, u):
                    moves.append(("add", u, v, {v: [*parents[v], u]}))
        edges = [(u, v) for v in names for u in parents[v]]
        for u, v in edges:
            if ("remove", u, v) not in tabu:
                moves.append(("remove", u, v, {v: [p for p in parents[v] if p != u]}))
        for u, v in edges:
            if ("flip", u, v) not in tabu and len(parents[u]) < max_indegree and not reaches(u, v, without=(u, v)):
                moves.append(("flip", u, v, {v: [p for p in parents[v] if p != u], u: [*parents[u], v]}))
        need = [key(c, ps) for *_, after in moves for c, ps in after.items()] + [key(c, ps) for c, ps in parents.items()]
        known |= local_scores(data, cards, [k for k in need if k not in known])
        best, move = -math.inf, None
        for m in moves:
            gain = sum(known[key(c, ps)] - known[key(c, parents[c])] for c, ps in m[3].items())
            if gain > best:
                best, move = gain, m
        if move is None or best < epsilon:
            break
        op, u, v, after = move
        parents.update(after)
        tabu.extend({"add": [("remove", u, v)], "remove": [("add", u, v)], "flip": [("flip", u, v), ("flip", v, u)]}[op])
    return spark.createDataFrame([(p, c) for c in names for p in parents[c]], schema)


def estimate_cpds(data: DataFrame, cards: dict[str, int], edges) -> DataFrame:
    """(variable, parent_config, child_value, probability): Laplace estimates for every configuration and value."""
    spark = data.sparkSession
    pairs = [(r[0], r[1]) for r in (edges.collect() if isinstance(edges, DataFrame) else edges)]
    out = None
    for v in cards:
        parents = [p for p, c in pairs if c == v]
        q = math.prod(cards[p] for p in parents)
        grid = spark.range(q * cards[v]).select(F.floor(F.col("id") / cards[v]).alias("parent_config"), (F.col("id") % cards[v]).alias("child_value"))
        counts = state_counts(data, cards, v, parents)
        totals = counts.groupBy("parent_config").agg(F.sum("n").alias("total"))
        full = grid.join(counts, ["parent_config", "child_value"], "left").join(totals, "parent_config", "left")
        one = full.select(F.lit(v).alias("variable"), "parent_config", "child_value", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + cards[v])).alias("probability"))
        out = one if out is None else out.union(one)
    return out
