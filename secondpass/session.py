"""Session builder and the shared scratch area.

Intermediate tables that must be read back exactly as they were written (rank
positions, prefix sums) go to the folder the cluster names in
``spark.checkpoint.dir``.  A private temporary folder is used only where that
setting is missing and the session is local; a cluster without it is refused.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def get_spark(app: str = "secondpass", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-secondpass-")
    return _FALLBACK[app]


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/secondpass-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Drop the scratch tables of this application, once no result reads them any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` once to shared storage and return a reader over that table.

    Every later use sees the same rows and the same positions, also when
    executors are lost and tasks are run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over the full number of shuffle partitions.

    For steps whose work is far larger than their bytes (Python functions):
    adaptive execution would merge such small partitions into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
