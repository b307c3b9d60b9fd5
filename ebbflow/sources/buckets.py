"""Stages in buckets of a key, for joins and aggregations without a shuffle.

A bucketed stage is a committed Parquet stage written as an external table: ``buckets`` files, one a task, each
holding the rows of one hash range of the key.  Tables of equal bucket counts join on the key, and aggregate by it,
where they lie.  The catalog entry belongs to the session; another session over the same stage root declares the
table anew over the committed files instead of writing them again.

The count is ``spark.ebbflow.buckets``, else the number of shuffle partitions, and is part of the path: stages of
another count are other stages.  A null key has a bucket like any other; an empty table gives an empty stage.
Bucket only tables whose keys have a bounded number of rows: a key's rows lie in one file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbflow.sources.stages import _committed, stage_path


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.ebbflow.buckets", spark.conf.get("spark.sql.shuffle.partitions")))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucketed_stage(spark: SparkSession, name: str, build: Callable[[], DataFrame], key: str = "msno",
                   sort: list[str] | None = None, cutoff: int | None = None, root: str | None = None,
                   source: str | None = None) -> DataFrame:
    """Reuse-or-build, like ``stages.run_stage``, in buckets of ``key``; rows of a bucket are ordered by ``sort``
    (the key where none is given), so bounds on the first of them skip row groups."""
    n, order = bucket_count(spark), sort or [key]
    path = f"{stage_path(spark, name, cutoff, root, source)}/buckets={n}"
    table = f"stage_{hashlib.md5(path.encode()).hexdigest()[:20]}"
    if not _committed(spark, path):
        # the hash of a repartition is that of the buckets: every task writes one file
        (build().repartition(n, key).write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(n, key).sortBy(*order).saveAsTable(table))
    elif not spark.catalog.tableExists(table):
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({_quoted(key)}) "
                  f"SORTED BY ({', '.join(map(_quoted, order))}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(table)
