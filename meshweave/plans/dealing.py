"""Order-aware dealing of rows without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_steps(n: int) -> list[int]:
    """Descending powers of two that reach ``n``: the strides of a binary search."""
    steps, s = [], 1
    while s <= n:
        steps.append(s)
        s *= 2
    return steps[::-1]


def count_at_most(cuts: list, value: Column, kind: str, test=None) -> Column:
    """How many of the ascending ``cuts`` satisfy ``cut <= value``: log2(n) steps a row, no join.

    ``cuts`` travels as one literal array, so its length must be bounded (a number of partitions).
    ``test(cut_column, value)`` may replace the comparison by another that is monotone in the cut.
    """
    if not cuts:
        return F.lit(0)
    test = test or (lambda cut, v: cut <= v)
    literal = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    # the fold carries the literal in its state so that its body refers to nothing outside
    start = F.struct(F.lit(0).alias("lo"), value.alias("v"))
    fold = F.aggregate(
        F.array(*[F.lit(s) for s in search_steps(len(cuts))]),
        start,
        lambda acc, s: F.struct(
            F.when((acc["lo"] + s <= len(cuts)) & F.coalesce(test(F.get(literal, acc["lo"] + s - 1), acc["v"]), F.lit(False)), acc["lo"] + s)
            .otherwise(acc["lo"])
            .alias("lo"),
            acc["v"].alias("v"),
        ),
        lambda acc: acc["lo"],
    )
    return fold
