"""Universe gate, active members, universe flags and the membership audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import exchange_of

OPEN_END = dt.date(9999, 12, 31)
UNIVERSE_STATUS = "OFFICIAL_SW_HISTORY_PLUS_CURRENT"


def interval_reach(membership: DataFrame) -> DataFrame:
    """Per (code, in_date) the latest inclusive end, an open end being the end of time.

    At most one row per code and day is left, however often intervals repeat.
    """
    return (
        membership.where("in_date is not null")
        .groupBy("code", "in_date")
        .agg(F.max(F.coalesce("out_date", F.lit(OPEN_END))).alias("until"))
    )


def universe_semi_join(bars: DataFrame, membership: DataFrame) -> DataFrame:
    """Bars on a day inside some membership interval of their code, both ends inclusive.

    A day is covered exactly if the largest end among the intervals that began
    on or before it is not earlier. That running maximum costs one ordered pass
    over bars and intervals of a code; a range join would test every pair of
    them.
    """
    marks = interval_reach(membership).select("code", F.col("in_date").alias("trade_date"), "until")
    w = (
        Window.partitionBy("code")
        .orderBy("trade_date", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = marks.withColumn("_side", F.lit(0)).unionByName(
        bars.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return (
        both.withColumn("_reach", F.max("until").over(w))
        .where("_side = 1 and _reach >= trade_date")
        .select(*bars.columns)
    )


def active_condition(asof: Column) -> Column:
    return (F.col("in_date") <= asof) & (F.col("out_date").isNull() | (F.col("out_date") >= asof))


def active_asof(membership: DataFrame, asof: dt.date) -> DataFrame:
    """Distinct codes that are members on a day."""
    return membership.where(active_condition(F.lit(asof))).select("code").distinct()


def universe_flags(master: DataFrame, membership: DataFrame) -> DataFrame:
    """Current and historical members with a flag for each.

    Both inputs are stacked and reduced per code: one exchange with map-side
    combining instead of two distincts and a full join.
    """
    current = master.select(
        "code", "name", F.coalesce("current_member", F.lit(0)).alias("_current"),
        F.lit(0).alias("_historical"),
    )
    historical = membership.select(
        "code", F.lit(None).cast("string").alias("name"), F.lit(0).alias("_current"),
        F.lit(1).alias("_historical"),
    )
    return (
        current.unionByName(historical)
        .groupBy("code")
        .agg(
            F.coalesce(F.max("name"), F.lit("")).alias("name"),
            F.max((F.col("_current") == 1).cast("int")).alias("current_member_snapshot"),
            F.max("_historical").alias("historical_member"),
        )
        .where("current_member_snapshot = 1 or historical_member = 1")
        .select(
            "code", "name", exchange_of(F.col("code")).alias("exchange"),
            "current_member_snapshot", "historical_member",
            F.lit(UNIVERSE_STATUS).alias("universe_status"),
        )
    )


def universe_counts(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count("*").alias("universe_codes"),
        F.coalesce(F.sum("historical_member"), F.lit(0)).alias("historical_codes"),
        F.coalesce(F.sum("current_member_snapshot"), F.lit(0)).alias("current_codes"),
    )


def membership_audit(master: DataFrame, membership: DataFrame, asof: dt.date) -> DataFrame:
    """Expected current members against the members active on a day."""
    expected = master.where("current_member = 1").select(
        "code", "name", F.lit(1).alias("_expected"), F.lit(0).alias("_active")
    )
    active = membership.where(active_condition(F.lit(asof))).select(
        "code", F.lit(None).cast("string").alias("name"), F.lit(0).alias("_expected"),
        F.lit(1).alias("_active"),
    )
    status = (
        F.when((F.col("expected_current") == 1) & (F.col("active_official") == 1), "MATCH")
        .when(F.col("expected_current") == 1, "MISSING_OFFICIAL")
        .otherwise("EXTRA_OFFICIAL")
    )
    return (
        expected.unionByName(active)
        .groupBy("code")
        .agg(
            F.coalesce(F.max("name"), F.lit("")).alias("name"),
            F.max("_expected").alias("expected_current"),
            F.max("_active").alias("active_official"),
        )
        .withColumn("status", status)
    )


def audit_outcome(audit: DataFrame) -> DataFrame:
    """LOADED if nothing expected is missing; extra members do not fail the audit."""
    missing = F.coalesce(F.sum((F.col("status") == "MISSING_OFFICIAL").cast("long")), F.lit(0))
    return audit.agg(
        F.coalesce(F.sum("expected_current"), F.lit(0)).alias("expected"),
        missing.alias("missing"),
        F.coalesce(F.sum("active_official"), F.lit(0)).alias("active_asof"),
        F.when(missing == 0, "LOADED").otherwise("AUDIT_FAILED").alias("status"),
    )


def missing_codes(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Codes of ``wanted`` without a row in ``present``."""
    return (
        wanted.select("code").distinct().join(present.select("code").distinct(), "code", "left_anti")
    )
