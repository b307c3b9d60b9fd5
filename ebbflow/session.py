"""Session helpers.  Library code never creates a session implicitly; tests and
``bench.py`` call :func:`local_session`."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


class SharedFolderMissing(RuntimeError):
    """The session names no shared folder for intermediate data."""


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ebbflow") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``.  A scratch folder is made only for a
    local session without the setting (tests, bench); on a cluster its absence is an error,
    because executors do not share a machine's temporary folders."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise SharedFolderMissing("spark.checkpoint.dir is not set: intermediate tables need a folder all executors share")
    path = tempfile.mkdtemp(prefix="ebbflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
