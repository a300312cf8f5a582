"""Connected components of pairs of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import cut_lineage


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: every node but the smallest of its component there, with that smallest one."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, places = np.unique(ends, return_inverse=True)
        x, y = places[: batch.num_rows], places[batch.num_rows :]
        root = np.arange(len(nodes))
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while (root[root] != root).any():
                root = root[root]
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["hi", "lo"])


def components(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` bigint to ``(id, component)``, the smallest number that can be reached. Numbers
    in no pair of two different ones have no row; pairs may repeat, none may be NULL.

    Star contraction: links to smaller numbers are bent towards the smallest neighbour from both
    ends in turn, until nothing moves. Before the first turn neighbouring links are contracted
    within each Arrow batch, which takes most of the length out of long chains.
    """
    links = pairs.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = links.repartitionByRange("hi").sortWithinPartitions("hi")
    links = cut_lineage(links.mapInArrow(_stars, "hi bigint, lo bigint").distinct())
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).head()
        if state == seen:
            break
        seen = state
        below = links.select(F.col("hi").alias("lo"), F.col("lo").alias("m"))
        low = below.union(links.select("lo", F.col("lo").alias("m"))).groupBy("lo").agg(F.min("m").alias("m"))
        links = links.join(low, "lo").select("hi", F.col("m").alias("lo")).distinct()
        low = links.groupBy("hi").agg(F.min("lo").alias("m"))
        side = links.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut_lineage(side.union(low.select("hi", F.col("m").alias("lo"))).distinct())
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )
