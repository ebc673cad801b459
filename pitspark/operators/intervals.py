"""Membership intervals from a classification history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import classification_version, inclusive_end, pad_code
from ..schemas import INDUSTRY_CODES

# Defaults of the membership table.
SECTOR_NAME = "农药"
SECTOR_INDEX_CODE = "850333"


def canonical_map(alias: DataFrame) -> DataFrame:
    """Historical code to canonical code, one row per historical code.

    Should a code be listed twice, the entry that became valid last wins.
    """
    return (
        alias.groupBy(pad_code(F.col("historical_code")).alias("source_code"))
        .agg(
            F.max_by(
                pad_code(F.col("canonical_code")), F.struct("valid_from", "canonical_code")
            ).alias("canonical_code")
        )
    )


def canonical_codes(history: DataFrame, alias: DataFrame) -> DataFrame:
    """Add ``code``: the canonical code, or the code itself. Not bounded by date."""
    return history.join(canonical_map(alias), "source_code", "left").select(
        *[c for c in history.columns], F.coalesce("canonical_code", "source_code").alias("code")
    )


def dedupe_history(history: DataFrame) -> DataFrame:
    """One row per (code, start_date, industry_code), greatest source code kept.

    After this step a code holds one row per day and category, which bounds the
    window partitions below.
    """
    return history.groupBy("code", "start_date", "industry_code").agg(
        F.max("source_code").alias("source_code")
    )


def derive_intervals(history: DataFrame) -> DataFrame:
    """Half-open intervals over *all* categories; the last one of a code is open."""
    w = Window.partitionBy("code").orderBy("start_date", "industry_code")
    return history.select(
        "code", "source_code", "industry_code", F.col("start_date").alias("in_date"),
        F.lead("start_date").over(w).alias("end_exclusive"),
    )


def in_category(intervals: DataFrame, codes: list[str] = INDUSTRY_CODES) -> DataFrame:
    """Keep the intervals of some categories. Only valid after the ends were derived."""
    return intervals.where(F.col("industry_code").isin(codes))


def merge_islands(intervals: DataFrame) -> DataFrame:
    """Merge intervals that touch: previous end equals next start, per code.

    The windows and the grouping reuse the partitioning by code of the interval
    derivation, so the step adds no exchange.
    """
    w = Window.partitionBy("code").orderBy("in_date", "industry_code")
    starts = ~F.lag("end_exclusive").over(w).eqNullSafe(F.col("in_date"))
    first_row = F.row_number().over(w) == 1
    place = F.struct("in_date", "industry_code")
    path = F.transform(F.array_sort(F.collect_list(place)), lambda x: x["industry_code"])
    return (
        intervals.withColumn("_new", (first_row | starts).cast("int"))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("code", "_island")
        .agg(
            F.min_by("source_code", place).alias("source_code"),
            F.array_join(path, "->").alias("industry_code"),
            F.min("in_date").alias("in_date"),
            F.max_by("end_exclusive", place).alias("end_exclusive"),
        )
        .drop("_island")
    )


def build_membership(history: DataFrame, alias: DataFrame) -> DataFrame:
    """History to merged in-category intervals."""
    deduped = dedupe_history(canonical_codes(history, alias))
    return merge_islands(in_category(derive_intervals(deduped)))


def membership_rows(
    islands: DataFrame, source_id: str = "S013", sector: str = SECTOR_NAME,
    index_code: str = SECTOR_INDEX_CODE,
) -> DataFrame:
    """Merged intervals in the membership table's schema, ends inclusive."""
    return islands.select(
        "code", "source_code",
        F.lit(sector).alias("sw_name"),
        F.lit(index_code).alias("sw_index_code"),
        F.col("industry_code").alias("source_industry_code"),
        F.lit(sector).alias("source_industry_name"),
        classification_version(F.col("industry_code")).alias("classification_version"),
        "in_date",
        inclusive_end(F.col("end_exclusive")).alias("out_date"),
        F.lit(None).cast("timestamp").alias("source_update_time"),
        F.lit(source_id).alias("source_id"),
        F.current_timestamp().alias("loaded_at"),
    )


def raw_rows(history: DataFrame, source_id: str = "S013") -> DataFrame:
    """Normalised input rows in the raw table's schema."""
    return history.select(
        "source_code", F.col("code").alias("canonical_code"), "start_date", "industry_code",
        F.lit("").alias("industry_name"), F.lit(None).cast("timestamp").alias("update_time"),
        F.lit(source_id).alias("source_id"), F.lit(None).cast("string").alias("raw_json"),
        F.current_timestamp().alias("loaded_at"),
    )
