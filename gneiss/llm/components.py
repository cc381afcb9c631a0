"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import shared_folder


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    # aggregated before it is joined, as a node can have a third of all edges; a skewed join is split, a window isn't
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _least_neighbour(down)
    inner = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); the component is its least node.

    The rounds grow with the logarithm of the nodes; each is checkpointed.  Loops and repeated edges do no harm, and
    nodes may be any 64-bit numbers.
    """
    shared_folder(edges.sparkSession)
    edges = edges.where("u <> v").distinct().checkpoint()
    seen = None
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
