"""Joins in which one key may own a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it owns more than one in so many rows; there are at most so many hot keys, at any size of the input.
SHARE = 10_000


def join_weighted(big: DataFrame, few: DataFrame, on: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``big`` with ``few``, which has one row per key and, in ``weight``, the number of rows of ``big``
    that have the key. Hot keys are joined by broadcast (at most ``SHARE`` rows) and then keep out of the way: they are
    dealt out by ``spread`` in the shuffle of the others. Rows with a null key match nothing."""
    values = [c for c in few.columns if c not in (*on, weight)]
    hot = few.filter(F.col(weight) * SHARE > total).select(*on, F.struct(*values).alias("_hot"))
    cold = few.filter(F.col(weight) * SHARE <= total).select(*on, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    out = big.join(F.broadcast(hot), on, "left")
    away = F.col("_hot").isNotNull()
    for c in on:
        away = away | F.col(c).isNull()
    out = out.withColumn("_salt", F.when(away, 1 + F.pmod(F.xxhash64(spread), F.lit(10_000)).cast("int")).otherwise(F.lit(0)))
    out = out.join(cold, [*on, "_salt"], "left")
    kept = [c for c in big.columns if c not in values]
    return out.select(*kept, *(F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values))
