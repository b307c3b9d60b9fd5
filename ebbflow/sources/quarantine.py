"""Typed CSV loads that keep bad rows aside (A1-A3).

``load_checked`` parses a file once, permissively, into a Parquet stage that has the raw line of every row that does
not fit the schema; good rows, bad rows and the counts are then reads of that stage, so they agree whichever columns a
reader asks for (a pruned CSV scan judges the columns it parses alone).  Bad rows are written to a quarantine folder,
and a load with more than the allowed share of them fails after they are there to look at.
A row is bad if a value does not parse, is outside its type, or columns are missing or too many.  Empty fields are null
and good; an empty file has no rows of either kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ebbflow.sources.stages import run_stage

BAD = "_bad_row"


class TooManyBadRows(ValueError):
    """Raised when a load has more bad rows than allowed."""

    def __init__(self, path: str, bad: int, rows: int, quarantine: str):
        super().__init__(f"{bad} of {rows} rows of {path} do not fit the schema; they are kept at {quarantine}")
        self.bad, self.rows, self.quarantine = bad, rows, quarantine


def load_checked(spark: SparkSession, path: str, schema: StructType, name: str, quarantine: str,
                 allowed_share: float = 0.0, root: str | None = None, source: str | None = None) -> DataFrame:
    """The good rows of a header CSV; bad rows go to ``quarantine`` as text, and more than ``allowed_share`` of all
    rows raise ``TooManyBadRows``."""
    def parse():
        # every column is parsed for the write, so every value is judged
        return (spark.read.schema(StructType([*schema.fields, StructField(BAD, StringType())]))
                .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path))

    typed = run_stage(spark, f"typed_{name}", parse, root=root, source=source)
    counts = typed.agg(F.count(F.lit(1)).alias("rows"), F.count(BAD).alias("bad")).first()
    if counts["bad"]:
        typed.where(F.col(BAD).isNotNull()).select(BAD).write.mode("overwrite").text(quarantine)
    if counts["bad"] > allowed_share * counts["rows"]:
        raise TooManyBadRows(path, counts["bad"], counts["rows"], quarantine)
    return typed.where(F.col(BAD).isNull()).drop(BAD)
