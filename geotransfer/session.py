"""Session settings and durable hand-over points between jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "geotransfer", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's own setting when there is one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative MLlib fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and read it back.

    Later jobs read the stored rows, so values that depend on the run (such as
    ``spark_partition_id``) stay fixed and lost executors only re-read files.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (the figure Spark's own broadcast rule uses)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
