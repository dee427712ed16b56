"""Connected components of links, by alternating large and small stars over joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import written

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).collect()[0]
    return row["n"], row["h"]


def _stars(edges: DataFrame) -> DataFrame:
    """Link each node's neighbours with the smallest node around: (a, b) with a > b becomes (a, min of a's group)."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return edges.join(least.hint("merge"), "u")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any orderable type to (node, component): the smallest node reachable. Nodes are those linked."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        # Small stars: each node's smaller neighbours, and the node itself, move to the smallest of them.
        joined = _stars(large)
        small = joined.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()
        edges = written(small, "links")
        if (now := _mark(edges)) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
    raise RuntimeError("components did not settle")
