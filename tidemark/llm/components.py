"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step aggregates minima with map-side combining and joins them back, so a node with very many
neighbours is combined in every task first; the joins are sort-merge joins that adaptive execution
splits where one node is hot.  Each round is written to the shared folder, which cuts the lineage, and
deleted when the next one is there.  The number of rounds grows as the logarithm of the longest chain;
more than ``max_rounds`` (60) end in an error, never in a part of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long); component: its smallest node.

    Loops, repeated edges and either direction are allowed; nodes with loops alone are left out.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: larger neighbours of a node move to its smallest neighbour
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        # small star: the node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, e = e, written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before, large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
