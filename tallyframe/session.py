"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
from datetime import datetime

from pyspark.sql import SparkSession

# Fixed value: the explicit "as of" instant used by tests and the oracle in place of the wall clock.
AS_OF = datetime(1998, 6, 1)


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tallyframe",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session tuned for the reconciliation workload.

    * AQE on: coalesces small shuffle partitions, splits skewed join partitions (one property key
      may hold a large share of the service rows) even where a later join then has to shuffle
      again, and switches joins to broadcast at run time when a side turns out small.
    * Broadcast threshold left at a fixed byte bound, so only sides with a checked size broadcast.
    * UI off: no web server in batch jobs.
    """
    master = master or os.environ.get("SPARK_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    A local session without the setting (as in tests) gets a fresh scratch folder.  Any other session
    must name one: a folder on one machine would leave each executor's files on its own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Spark Connect) session has no SparkContext
        if current := spark.conf.get("spark.checkpoint.dir", None):
            return current
        raise RuntimeError(_NO_FOLDER) from None
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(_NO_FOLDER)
        current = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_NO_FOLDER = "set spark.checkpoint.dir to a folder that the driver and all executors share"


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (classic or remote session)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", None) or str(id(spark))
