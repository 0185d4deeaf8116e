"""Spark session helpers.

Every operator in this package is a pure ``DataFrame -> DataFrame`` function
and never depends on session settings for its *result*; the settings below
only steer the physical plan (AQE, skew handling, Arrow transfer).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Session settings applied by ``get_spark``.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splitting covers a key
# that holds a large share of the rows.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.files.maxPartitionBytes": "128m",
}


CLUSTER_PARTITIONS = 8192


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "runlake", extra: dict | None = None) -> SparkSession:
    """Session with the settings above.

    The master is the given one, else the one the cluster configured, else
    local.  On a cluster shuffles start with many partitions, which AQE merges
    where they turn out small; locally they match the cores."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or SparkConf().get("spark.master", None) or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    initial = cpus if master.startswith("local") else CLUSTER_PARTITIONS
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or initial)
    conf["spark.driver.memory"] = os.environ.get("RUNLAKE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only when it is unset (local tests) a scratch folder is
    created and registered.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="runlake-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def state_location(spark: SparkSession, name: str) -> str:
    """Checkpoint location for a streaming query under the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}"
