"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table of the input folder.

    ``spread`` is for expensive per-row work: a file too small to be split would
    leave it to one task, so its rows are dealt out to all cores. An input that
    is large enough to be split is read as it is.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df
