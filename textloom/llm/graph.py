"""Connected components of a large edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import dropped, written


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least node reachable.

    Each round links every node's larger, then smaller neighbours to its least
    neighbour, which halves the depth of the trees; every round is a written
    table, so neither lineage nor memory grows.  Loops are dropped.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least(least, F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every pair now points down; a node's smaller neighbours meet at the least of them
        down = large.where("a <> b").distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        small = down.withColumn("m", m)
        after = written(
            small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(),
            "edges",
        )
        state = after.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(now)
        now = after
        if (state["n"], state["h"]) == last:
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
