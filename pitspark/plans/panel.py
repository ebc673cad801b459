"""The point-in-time panel: features, outcomes, universe gate and known fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.asof import collapse_facts, guard_look_ahead
from ..operators.features import with_labels, with_rolling
from ..operators.membership import interval_reach
from ..schemas import FIN
from ..sources.bars import tradable_bars


def build_panel(bars: DataFrame, membership: DataFrame, facts: DataFrame) -> DataFrame:
    """Labelled panel of member days with the fundamentals known on each day.

    Rows of codes that never were members are dropped before the windows, which
    keeps whole histories and so changes no feature. Features and labels see
    the full history of a code; the universe gate and the as-of match follow in
    one ordered pass over bars, interval starts and facts. Everything is keyed
    by code, so the bars are shuffled once.
    """
    marks = interval_reach(membership)
    members = marks.select("code").distinct()
    own = tradable_bars(bars).join(members, "code", "left_semi")
    rows = with_labels(with_rolling(own))
    columns = rows.columns
    known = collapse_facts(facts.join(members, "code", "left_semi"))
    # Both short sides are brought to the partitioning the bars already have, so
    # the union keeps it and the wide rows are not shuffled again.
    starts = marks.repartition("code").select(
        "code", F.col("in_date").alias("trade_date"), "until", F.lit(0).alias("_side")
    )
    known = known.repartition("code").select(
        "code", F.col("available_date").alias("trade_date"), "_fact", F.lit(0).alias("_side")
    )
    stacked = (
        rows.withColumn("_side", F.lit(1))
        .unionByName(starts, allowMissingColumns=True)
        .unionByName(known, allowMissingColumns=True)
    )
    w = (
        Window.partitionBy("code")
        .orderBy("trade_date", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    panel = (
        stacked.withColumns(
            {"_reach": F.max("until").over(w), "_match": F.last("_fact", ignorenulls=True).over(w)}
        )
        .where("_side = 1 and _reach >= trade_date")
        .select(*columns, "_match.*")
    )
    return guard_look_ahead(panel).select(*columns, *FIN, "financial_available_date")
