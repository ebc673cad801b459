"""Universe files: one row per listing code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import exchange_or_derived
from .landing import read_csv_by_header


def dedupe_universe(rows: DataFrame, order: Column, keep: str = "first") -> DataFrame:
    """One row per trimmed, non-blank code: the first or the last that landed.

    An aggregate rather than a ranking window, so copies of one code are
    reduced before the shuffle and no task ever holds all of them.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    pick = F.min_by if keep == "first" else F.max_by
    optional = {
        name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
        for name in ("name", "exchange")
    }
    code = F.trim("code")
    return (
        rows.select(code.alias("code"), order.alias("_order"),
                    F.struct(*[c.alias(n) for n, c in optional.items()]).alias("_row"))
        .where("code <> ''")
        .groupBy("code")
        .agg(pick("_row", "_order").alias("_row"))
        .select(
            "code",
            exchange_or_derived(F.col("_row.exchange"), F.col("code")).alias("exchange"),
            F.coalesce("_row.name", F.lit("")).alias("name"),
        )
    )


def read_universe(spark: SparkSession, path: str, keep: str = "first") -> DataFrame:
    """CSV universe scan. Columns are matched by the header of each file and read as text."""
    return dedupe_universe(read_csv_by_header(spark, path), F.col("arrival"), keep)
