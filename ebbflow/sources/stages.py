"""Stage runner (A7), materialise-once (A8) and required-input guard.

A stage is a directory of Parquet files under a shared root.  ``run_stage``
returns the stored table when the directory holds a committed write (Spark's
``_SUCCESS`` marker), otherwise it computes, writes and reads back - so a lost
executor or a rerun never recomputes finished stages, and lineage is cut at each
stage boundary.  The root defaults to the session's ``spark.checkpoint.dir``
(the shared folder the cluster names), never a machine-local temp folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class MissingStageError(FileNotFoundError):
    """Raised when a required upstream stage output is absent or incomplete."""

    def __init__(self, stage: str, path: str):
        super().__init__(f"required stage '{stage}' has no committed output at {path}; run that stage first")
        self.stage = stage
        self.path = path


def stage_root(spark: SparkSession, root: str | None = None) -> str:
    if root:
        return root
    ckpt = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not ckpt:
        raise ValueError("no stage root given and spark.checkpoint.dir is unset")
    return ckpt.rstrip("/") + "/stages"


def _committed(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def input_identity(spark: SparkSession, folder: str) -> str:
    """A short name for the present content of an input folder: its path and the names, sizes and
    times of the files below it.  Replaced inputs get another identity."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = fs.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.md5("\n".join([str(fs.makeQualified(path)), *sorted(found)]).encode()).hexdigest()[:16]


def stage_path(spark: SparkSession, name: str, cutoff: int | None = None, root: str | None = None,
               source: str | None = None) -> str:
    """``<root>/<name>[/input=<identity>][/cutoff=<cutoff>]``; ``source`` is an input identity or a run id."""
    inputs = f"/input={source}" if source is not None else ""
    suffix = f"/cutoff={cutoff}" if cutoff is not None else ""
    return f"{stage_root(spark, root)}/{name}{inputs}{suffix}"


def run_stage(spark: SparkSession, name: str, build: Callable[[], DataFrame], cutoff: int | None = None,
              root: str | None = None, partition_by: list[str] | None = None, source: str | None = None,
              options: dict[str, str] | None = None) -> DataFrame:
    """Reuse-or-build: read the committed stage output, else build, write with the given options, read.
    Key columns keep their string type through the Parquet schema."""
    path = stage_path(spark, name, cutoff, root, source)
    if not _committed(spark, path):
        writer = build().write.mode("overwrite").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def require_stage(spark: SparkSession, name: str, cutoff: int | None = None, root: str | None = None,
                  schema: StructType | None = None, source: str | None = None) -> DataFrame:
    """Load an upstream stage or raise a typed error naming it; optionally
    check that the expected columns are present."""
    path = stage_path(spark, name, cutoff, root, source)
    if not _committed(spark, path):
        raise MissingStageError(name, path)
    df = spark.read.parquet(path)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise MissingStageError(f"{name} (missing columns {missing})", path)
    return df
