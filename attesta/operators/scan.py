"""Running sums and ranks over an ordered table that does not fit one task.

A window without partition columns, or with a hot partition, sorts everything in
one task. A large table is therefore range-partitioned on its order first and
written down, so that every row has a fixed range. Each range is scanned on its
own, and the totals of the ranges before it supply the rest. That is the plan for
tables of every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import cut_lineage


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    out: str = "running",
    partition: Sequence[str] = (),
) -> DataFrame:
    """Add the inclusive running sum of ``value``.

    ``order`` holds ascending, not-null expressions that together are unique
    within the partition columns; descending order is asked for by negating a
    number. The table is written once, so hand in the columns that are needed
    and no more.
    """
    part = list(partition)
    ranged = cut_lineage(df.withColumn("_value", value).repartitionByRange(*part, *order))
    # The written partitions are the ranges; their numbers do not change any more.
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and partition value that occurs in it.
    totals = cut_lineage(ranged.groupBy(*part, "_range").agg(F.sum("_value").alias("_total")))
    starts = totals.select(
        *[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)],
        F.col("_range").alias("_r"),
        F.sum("_total").over(before).alias("_before"),
    )
    within = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_value").over(within))
    same = F.col("_range") == F.col("_r")
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    if not part:
        # One row per range: as many as there are shuffle partitions.
        starts = F.broadcast(starts)
    return local.join(starts, same).select(
        *df.columns, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).alias(out)
    )


def row_rank(
    df: DataFrame, order: Sequence[Column], out: str = "rn", partition: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based position in ``order``, per partition value if given."""
    return running_sum(df, F.lit(1).cast("bigint"), order, out, partition)
