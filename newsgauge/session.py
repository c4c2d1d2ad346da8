"""Session settings and the few run-time knobs that depend on data volume."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # By rows alone a batch of long texts has no bound in a Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Spark 4.1 trusts the partitioning of a union's children even after adaptive execution has changed one of them;
    # a distinct or a grouping above it then leaves copies.
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(app_name: str = "newsgauge", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Partitions that keep a shuffled block near ``target_bytes``, never fewer than the cores.

    AQE merges the small ones, so a generous number is cheap and a small one spills.
    """
    return max(cores, math.ceil(input_bytes / target_bytes))


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, a temp one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="newsgauge-")
    context.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """Written once to the shared folder and read again, so that several readers do not each make it anew. What the write
    shuffled goes when it is done."""
    df.sparkSession.conf.set(CLEANUP, "true")
    path = f"{shared_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
