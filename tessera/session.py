"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; ``configure`` only adds
the SQL settings the engine relies on (UTC, AQE, skew handling, a bounded
broadcast threshold), and only where the session has none of its own.
``shared_dir`` returns the folder named by ``spark.checkpoint.dir`` or set on
the context; a private temporary folder is created only for a local master.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Broadcast joins happen only below this estimated size; anything larger falls
# back to a shuffle join.  AQE re-checks the estimate with runtime statistics.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_LIMIT_BYTES),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_LIMIT_BYTES),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the session lacks; those its operator has set stay."""
    own = spark.conf.getAll
    for key, value in SQL_SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Session for tests and the local bench; the web UI stays off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and staged files.

    Read from ``spark.checkpoint.dir``, else the folder set on the context;
    only where both are unset and the master is local (tests) a fresh
    temporary folder is created and registered.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", current)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current.rstrip("/")


_STAGED: list[str] = []


def staging_path(spark: SparkSession, label: str) -> str:
    """A new, unique folder under the shared folder for one staged write."""
    path = f"{shared_dir(spark)}/staging/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def clear_staging(spark: SparkSession) -> int:
    """Delete what this driver has staged; results that still read it must have
    been written before.  Returns the number of folders deleted."""
    deleted = 0
    while _STAGED:
        where = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        deleted += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return deleted
