"""Session settings and the shared folder for cut lineage and run outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Expressions over arrays make many calls to the JVM; recording the Python
    # line of each one takes longer than the call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "deskspark", **settings: str) -> SparkSession:
    """Session with adaptive execution on and UTC time.

    Shuffle width, memory and the master belong to the cluster, so they are
    only set when passed in.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with its executor.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, never reused."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
