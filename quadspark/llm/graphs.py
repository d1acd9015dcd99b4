"""Connected components of an edge table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.scratch import Scratch


#: Edges that one task of a round handles; tasks are as many as the measured number of edges needs.
TASK_EDGES = 250_000


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` of every node with an edge ``(a, b)``; the label is the least node it reaches.

    Alternating large and small stars: each round points nodes at smaller ones, so the number of
    rounds grows with the logarithm of a component's size. Each round is written to the scratch
    folder, in as many parts as its size asks for. A node with very many edges is summed map-side, and
    its join is left to AQE to split.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    step = 0
    while True:
        count, open_nodes = _state(now)
        if not open_nodes:
            break
        tasks = 2 + count // TASK_EDGES
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.coalesce(tasks).distinct().coalesce(tasks), f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.withColumnRenamed("m", "v")).coalesce(tasks).distinct()
        after = scratch.save(small.coalesce(tasks), f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-large-{step}")
        now, step = after, step + 1
    # every node but the least now points at it
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that keep them from being stars: with two edges down, or with edges both ways."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
    down, open_nodes = nodes.agg(F.sum("down"), F.count(F.when((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("all") > F.col("down"))), 1))).first()
    return down or 0, open_nodes
