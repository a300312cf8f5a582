"""Tables that a job of several steps writes for itself, in the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attesta.session import ensure_checkpoint_dir


class Workspace:
    """A folder of Parquet tables below the checkpoint folder.

    A written table cuts the lineage as a checkpoint does and outlives its executors. It is compressed, its size is known to
    the optimizer, small files are read together, and it goes when the job says so instead of when garbage is collected.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self._spark = spark
        self._folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written down and read again."""
        self._count += 1
        path = f"{self._folder}/{self._count}"
        df.write.option("compression", "zstd").parquet(path)
        # The schema is known; empty tables and tables of many files need no look at their footers.
        return self._spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete all tables. What reads them must have been computed before."""
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
