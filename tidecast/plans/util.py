"""Output conventions shared by registered queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6
# Values computed from 2-decimal data often sit exactly on a 6-decimal rounding tie,
# where summation-order noise (~1e-15) decides the side.  A nudge far above that
# noise and far below 1e-6 moves every value off the tie the same way in both engines.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column after the tie nudge (``+ 0.0`` folds -0.0 into 0.0)."""
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    """SQL select item: rounded double with the same -0.0 folding."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE!r}, {digits}) + 0.0 AS {alias}"
