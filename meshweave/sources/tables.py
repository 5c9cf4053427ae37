"""Graphs and samples from the order tables. Every line item is an edge, so there are parallel edges, and loops where a part follows itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import Graph

#: An edge's id is ``order key * ID_STEP`` plus the line item's place in its order.
ID_STEP = 1 << 20
#: The order of an order's line items; rows that tie in all of these are the same edge twice.
PLACES = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
#: Cardinalities of the sample columns.
K2_CARDS = {"returnflag": 3, "linestatus": 2, "linenumber": 7, "quantity": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``edge_id`` and the part ``next`` in the order."""
    w = W.partitionBy("l_orderkey").orderBy(*PLACES)
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    place = F.row_number().over(w) - F.lit(1)
    return line.select("*", (F.col("l_orderkey").cast("long") * ID_STEP + place).alias("edge_id"), F.lead("l_partkey").over(w).alias("next"))


def order_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders (even ids) and parts (odd ids), an edge for each line item: its quantity as weight, its supplier as branch."""
    i64 = lambda c: F.col(c).cast("long")
    edges = _lines(spark, sf_dir).select(
        "edge_id", (i64("l_orderkey") * 2).alias("src"), (i64("l_partkey") * 2 + 1).alias("dst"), i64("l_suppkey").alias("branch_id"), F.col("l_quantity").cast("double").alias("weight")
    )
    orders = read(spark, sf_dir, "orders").select((i64("o_orderkey") * 2).alias("node_id"))
    parts = read(spark, sf_dir, "part").select((i64("p_partkey") * 2 + 1).alias("node_id"))
    ends = read(spark, sf_dir, "lineitem").select(F.explode(F.array(i64("l_orderkey") * 2, i64("l_partkey") * 2 + 1)).alias("node_id"))
    return Graph(orders.union(parts).union(ends), edges)


def part_next(spark: SparkSession, sf_dir: str, acyclic: bool = False) -> Graph:
    """Each part to the next one in an order, an edge for each such place; acyclic: from the smaller to the larger part."""
    pairs = _lines(spark, sf_dir).where("next is not null").select("edge_id", F.col("l_partkey").cast("long").alias("a"), F.col("next").cast("long").alias("b"))
    if acyclic:
        pairs = pairs.where("a <> b").select("edge_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = pairs.select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return Graph(edges.select(F.explode(F.array("src", "dst")).alias("node_id")), edges, directed=True)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four small integer columns of every line item."""
    code = lambda c, values: sum((F.when(F.col(c) == v, k).otherwise(0) for k, v in enumerate(values)), F.lit(0))
    return read(spark, sf_dir, "lineitem").select(
        code("l_returnflag", "ANR").cast("int").alias("returnflag"),
        code("l_linestatus", "FO").cast("int").alias("linestatus"),
        (F.col("l_linenumber") - 1).cast("int").alias("linenumber"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("quantity"),
    )


#: Cardinalities of the columns of :func:`dependent_samples`.
DEPENDENT_CARDS = {"quantity": 5, "large": 2, "price": 4, "both": 2, "returnflag": 3}


def dependent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every line item that depend on each other: ``both`` on two of them together, ``returnflag`` on none."""
    line = read(spark, sf_dir, "lineitem")
    n, price = F.col("l_quantity"), F.col("l_extendedprice")
    code = sum((F.when(F.col("l_returnflag") == v, k).otherwise(0) for k, v in enumerate("ANR")), F.lit(0))
    return line.select(
        F.floor((n - 1) / 10).cast("int").alias("quantity"),
        (n > 25).cast("int").alias("large"),
        F.when(price < 20000, 0).when(price < 40000, 1).when(price < 60000, 2).otherwise(3).alias("price"),
        ((n > 25) != (F.col("l_linenumber") > 3)).cast("int").alias("both"),
        code.cast("int").alias("returnflag"),
    )
