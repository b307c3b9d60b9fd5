"""Small driver-side result tables (a handful of rows: thresholds, per-model
metrics, fixed dimensions) as JVM-side literal frames.

``spark.createDataFrame(list)`` ships the rows through a Python RDD, so the
first one in a session starts Python workers; a literal ``inline(array(struct))``
over a one-row range stays in the JVM and plans like a local relation.  Lists
above ``MAX_LITERAL_ROWS`` take the ordinary path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

MAX_LITERAL_ROWS = 1000


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def small_frame(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    rows = list(rows)
    st = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    if len(rows) > MAX_LITERAL_ROWS:
        return spark.createDataFrame(rows, st)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(_plain(v)).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
