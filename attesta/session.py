"""Spark session helpers: defaults for local use and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "attesta", cpus: int | str | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass the
    platform's own session to the operators instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_attesta_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="attesta-package-")) / "attesta.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._attesta_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local master without that setting gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder does not outlive
    its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably, so that loops neither grow their plan nor
    lose progress with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores before expensive work per row. Few bytes can
    carry much work, and merging small partitions would leave it to one task."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts)
