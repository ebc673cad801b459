"""Classification history: which category a listing belonged to from which day on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import pad_code
from .landing import require_rows


def normalise_history(rows: DataFrame) -> DataFrame:
    """``symbol, start_date, industry_code`` text to code, date and clean category."""
    symbol = F.split_part(F.col("symbol").cast("string"), F.lit("."), F.lit(1))
    return rows.select(
        pad_code(symbol).alias("source_code"),
        F.to_date("start_date").alias("start_date"),
        F.trim(F.replace(F.col("industry_code").cast("string"), F.lit(".0"), F.lit(""))).alias(
            "industry_code"
        ),
    )


def read_history(rows: DataFrame) -> DataFrame:
    """As ``normalise_history``, but an empty history is an error."""
    return normalise_history(require_rows(rows, "classification history"))
