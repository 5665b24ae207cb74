"""Session and scratch-folder helpers shared by the bench, the tests and the plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "colloquy", cpus: str | int = "*") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Test tables are small but their rows are costly; keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("COLLOQUY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder the cluster names.

    The folder must be visible to every executor, so it is read from
    ``spark.checkpoint.dir``. Only a local session without that setting makes a
    temporary folder of its own; a cluster without it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="colloquy-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/colloquy/{purpose}-{uuid.uuid4().hex}"
