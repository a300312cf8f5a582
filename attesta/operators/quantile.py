"""The value at a fraction of the sorted column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.scan import running_sum
from attesta.session import cut_lineage


def index_quantiles(df: DataFrame, col: str, fractions: list[float]) -> DataFrame:
    """``(fraction, value)`` with the value at index ``min(n-1, int(f*n))`` of the
    sorted column: a stored value, never an interpolated one.

    Works on counts per distinct value, so copies cost nothing and no task sees
    the whole column.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    upto = running_sum(counts, F.col("n"), [F.col("value")], out="upto")
    total = counts.agg(F.sum("n")).head()[0] or 0
    if total == 0:
        return counts.select(F.lit(0.0).alias("fraction"), "value").limit(0)
    asked = F.array(
        *[F.struct(F.lit(float(f)).alias("f"), F.lit(min(total - 1, int(f * total))).alias("at")) for f in fractions]
    )
    here = F.filter(asked, lambda a: (a["at"] < F.col("upto")) & (a["at"] >= F.col("upto") - F.col("n")))
    return upto.select("value", F.explode(here).alias("a")).select(F.col("a.f").alias("fraction"), "value")
