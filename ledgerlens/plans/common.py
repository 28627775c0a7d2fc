"""Helpers shared by the query modules: oracle-comparable output shape."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType

DIGITS = 6


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places (summation order differs between engines)
    and turn booleans into 0/1 ints, so results hash the same in both."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # "+ 0.0" turns a rounded -0.0 into 0.0 (same text in every engine)
            cols.append((F.round(F.col(f.name), DIGITS) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, BooleanType):
            cols.append(F.col(f.name).cast("int").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded(sql: str, double_cols) -> str:
    """Wrap oracle SQL so the listed DOUBLE columns are rounded like ``finish``."""
    if not double_cols:
        return sql
    rep = ", ".join(f'(round(CAST("{c}" AS DOUBLE), {DIGITS}) + 0.0) AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
