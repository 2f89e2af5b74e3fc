"""Connected components by alternating large-star and small-star steps, as DataFrames.

Every step is an aggregate (with map-side minima) and a join that AQE can split, so a node
with a third of all edges is no single task's work. Each round is written to the shared
folder; nothing but two sums a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.select("a", F.col("m").alias("b")).union(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type to (node, root): each node's smallest reachable node.

    Loops, repeats, either direction and null ends are taken; loops and nulls link nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = total(now)
    for _ in range(rounds if seen[0] else 0):
        after = written(_small_star(_large_star(now)), "edges")
        release(now)
        now, last, seen = after, seen, total(after)
        if seen == last:
            break
    else:
        if seen[0]:
            raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
