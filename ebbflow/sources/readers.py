"""Typed CSV/Parquet readers for the raw tables (A1-A4) and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.sources import schemas


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV (or Parquet) with the fixed 9-column schema."""
    return _read(spark, path, schemas.TRANSACTIONS)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """A2: members dimension with its fixed schema."""
    return _read(spark, path, schemas.MEMBERS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A3: labels of one round."""
    return _read(spark, path, schemas.LABELS)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A5: distributed sink.  CSV gets a header and no index, like the original files."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def export_queue(df: DataFrame, path: str, columns: list[str]) -> None:
    """A10: export the chosen columns of a filtered list as CSV, written by the
    executors (no collect)."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_json_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A6 reader: a JSON summary document, one per line (as ``write.json`` makes it)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """A6 sink: nested structs / arrays of structs serialised as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def to_json_column(df: DataFrame, name: str = "document") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
