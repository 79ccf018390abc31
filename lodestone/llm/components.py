"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of the component) of every node of edges (a, b: longs); self-loops and nulls are ignored.

    Large star: each node's larger neighbours move to its smallest neighbour. Small star: its smaller ones do. After each round
    the edges are a shared table again, so lineage stays short; the rounds, about the logarithm of the longest path, end when a round changes nothing, and not before. Neighbour
    minima are aggregates with partial sums, so a node with very many neighbours is no hot task.
    """
    now = shared.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (sums := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())) != before:
        before, old = sums, now
        now = shared.table(small_star(large_star(old)), "edges")
        shared.remove_table(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """For each node u with neighbours N: (v, min(N, u)) for v in N, v > u. Pairs may stand there more than once."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """For each node u with smaller neighbours N: (v, min(N)) for v in N and u itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
