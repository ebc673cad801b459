"""Backward as-of join of facts to bars, and the guard against looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import FIN

AVAILABLE = "financial_available_date"


class LookAheadError(RuntimeError):
    """A fact was joined to a day on which it was not yet known."""


def collapse_facts(facts: DataFrame, payload: list[str] = FIN) -> DataFrame:
    """One fact per (code, available_date): greatest (report_period, revision_id).

    A tie goes to the later announcement, the last part of the key. Restatements of one day shrink on the map side; afterwards a code holds at
    most one fact per calendar day.
    """
    fact = F.struct(F.col("available_date").alias(AVAILABLE), *payload)
    return (
        facts.where("available_date is not null")
        .groupBy("code", "available_date")
        .agg(F.max_by(fact, F.struct("report_period", "revision_id", "ann_date")).alias("_fact"))
    )


def asof_fundamentals(bars: DataFrame, facts: DataFrame, payload: list[str] = FIN) -> DataFrame:
    """Add the latest fact known on each bar's day (same day included).

    Both sides are stacked and read in time order, facts before bars; the last
    fact seen is the match. The fact travels as a struct, so a NULL inside the
    matched fact stays NULL instead of being filled from an older one. Bars
    without a fact are kept.
    """
    known = collapse_facts(facts, payload).select(
        "code", F.col("available_date").alias("trade_date"), "_fact", F.lit(0).alias("_side")
    )
    both = known.unionByName(bars.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = (
        Window.partitionBy("code")
        .orderBy("trade_date", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.withColumn("_match", F.last("_fact", ignorenulls=True).over(w))
        .where("_side = 1")
        .select(*bars.columns, "_match.*")
    )


def look_ahead_rows(panel: DataFrame) -> DataFrame:
    return panel.where(F.col(AVAILABLE) > F.col("trade_date"))


def guard_look_ahead(panel: DataFrame) -> DataFrame:
    """Fail the query on the first joined fact that lies in the future.

    The check is a filter inside the plan, so it costs no extra job.
    """
    message = F.concat(
        F.lit("fundamentals look ahead: "), F.col("code"), F.lit(" "), F.col("trade_date")
    )
    ahead = F.col(AVAILABLE) > F.col("trade_date")
    return panel.where(F.when(ahead, F.raise_error(message).cast("boolean")).otherwise(True))


def assert_no_look_ahead(panel: DataFrame) -> None:
    """Count the offending rows and raise if there is one."""
    n = look_ahead_rows(panel).count()
    if n:
        raise LookAheadError(f"fundamentals look ahead: {n} rows")
