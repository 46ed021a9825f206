"""Connected components of an edge table by alternating stars, cut after each round. Hubs are split: a node's edges meet its least neighbour in lookups
that deal out hot nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import cut, spread_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    met = spread_lookup(both.filter("v > u"), least, "u", "n", "v", ["m"])
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these. Edges come as u > v."""
    edges = cut(edges)
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    moved = spread_lookup(edges, least, "u", "n", "v", ["m"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: orderable, not null) but the roots; root is the least node reachable.

    Loops and repeated edges do no harm; no edges give no rows. A round that changes no edge is the last (the edges are compared, not sums of them). Rounds grow
    with the logarithm of the longest path; more than ``rounds`` raises an error rather than returning part of the work.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = now.count()
    for _ in range(rounds):
        if not n:
            break
        new = cut(_small_star(_large_star(now)))
        n_new = new.count()
        same = n == n_new and new.join(now, ["u", "v"], "left_anti").isEmpty()
        now, n = new, n_new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
