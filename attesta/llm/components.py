"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.workspace import Workspace
from attesta.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b). Large: the greater neighbours of each node move to the smallest; small: the
    node and its smaller neighbours move to the smallest."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Minimum per node first (combined before the shuffle); the neighbours are then joined to it, never listed.
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return moved.filter("a > b").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns id, component: each linked node with the smallest node that it can reach. Nulls and loops link nothing.

    The number of rounds grows with the logarithm of the longest chain. Only counts reach the driver. Each round is written
    down and goes once the next one is there.
    """
    space = Workspace(links.sparkSession)
    edges = space.write(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    state = None
    while True:
        before, space = space, Workspace(links.sparkSession)
        edges = space.write(_star(_star(edges, True), False))
        before.remove()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # At rest every node hangs on its component's smallest node.
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
    found = cut_lineage(found)
    space.remove()
    return found
