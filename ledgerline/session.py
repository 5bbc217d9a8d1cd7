"""Session defaults and the shared working folder.

Work files (rendered inputs, staging, checkpoints) live under the cluster's
shared ``spark.checkpoint.dir``, which is read from the session.  Only in local
mode may it be unset; a private folder is then created.  Elsewhere a folder of
the driver would be invisible to the executors, so that is an error.  Tables
that must outlive checkpoints (published versions, run log) go to
``spark.ledgerline.workspace.dir`` where it is set.
"""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
WORKSPACE_KEY = "spark.ledgerline.workspace.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerline", driver_memory: str = "8g",
                  extra_conf: dict | None = None) -> SparkSession:
    """Session for local runs and tests.  On a cluster the deployment sets
    memory and parallelism; only SQL defaults matter there."""
    builder = SparkSession.builder
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(master)
        .config("spark.driver.memory", driver_memory)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no broadcast from static size estimates; AQE broadcasts a join side
        # only when its measured (runtime) size is small
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only in local mode."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        check_local(spark.sparkContext.master)
        root = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def check_local(master: str) -> None:
    """A work folder of the driver is only right when everything runs there."""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors "
                         f"of {master} share")


def workspace_root(spark: SparkSession) -> str:
    """Folder of published tables and run logs."""
    return (spark.conf.get(WORKSPACE_KEY, None) or work_root(spark)).rstrip("/")


def work_root(spark: SparkSession) -> str:
    """Folder for this library's work files inside the shared checkpoint dir."""
    return ensure_checkpoint_dir(spark) + "/ledgerline"


@contextmanager
def job_description(spark: SparkSession, text: str):
    """Label the Spark jobs started inside the block (shown in event logs and
    job listings), restoring the previous label afterwards."""
    sc = spark.sparkContext
    previous = sc.getLocalProperty("spark.job.description")
    sc.setJobDescription(text)
    try:
        yield
    finally:
        sc.setJobDescription(previous)
