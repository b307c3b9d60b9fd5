"""Helpers shared by the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` so results compare exactly
    across engines (summation order changes the last bits)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def sql_final(body: str, doubles: list[str], digits: int = 6) -> str:
    """Wrap an oracle SELECT so the listed DOUBLE columns are rounded like
    :func:`finalize`."""
    if not doubles:
        return body
    repl = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({body}) _q"
