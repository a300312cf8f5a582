"""Dense vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(_c(a), lambda x: x.cast("double"))).otherwise(
        F.transform(_c(a), lambda x: x.cast("double") / n)
    )


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
