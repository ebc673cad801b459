"""Half-hour activity slots: painting, hours, plan versus actual, weekly totals, to-dos."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import EMPTY_SLOT

GOAL_HOURS = 8.0
GOAL_TYPE = "bud"
WEEKLY_TARGET = 10.0
SLOT_HOURS = 0.5


def paint_slots(paints: DataFrame) -> DataFrame:
    """Slot states after all paints: a paint covers a range, the later one wins.

    Each paint is at most 48 slots long. Paints of one slot are reduced on the
    map side, so a busy user is never gathered in one task.
    """
    span = F.sequence(F.least("start_slot", "end_slot"), F.greatest("start_slot", "end_slot"))
    return (
        paints.select("user_id", "kind", "day", "type", "paint_order", F.explode(span).alias("slot"))
        .groupBy("user_id", "kind", "day", "slot")
        .agg(F.max_by("type", "paint_order").alias("type"))
    )


def filled(slots: DataFrame) -> DataFrame:
    """Slots with an entry; a missing, NULL or cleared slot is empty."""
    return slots.where(F.col("type").isNotNull() & (F.col("type") != EMPTY_SLOT))


def _recorded(slots: DataFrame) -> DataFrame:
    return filled(slots.where("kind = 'actual'"))


def hours_by_type(slots: DataFrame) -> DataFrame:
    """Recorded hours per user, day and category; categories without hours are absent."""
    return (
        _recorded(slots)
        .groupBy("user_id", "day", "type")
        .agg((F.count("*") * SLOT_HOURS).alias("hours"))
    )


def plan_vs_actual(slots: DataFrame) -> DataFrame:
    """Status of each touched slot. Plan and actual meet in one grouped pass, not a join."""
    def entry(kind: str) -> Column:
        present = (F.col("kind") == kind) & (F.col("type") != EMPTY_SLOT)
        return F.max(F.when(present, F.col("type")))

    plan, actual = F.col("plan_type"), F.col("actual_type")
    status = (
        F.when(actual.isNotNull() & actual.eqNullSafe(plan), "resonance")
        .when(actual.isNotNull(), "recorded")
        .when(plan.isNotNull(), "planned")
        .otherwise("empty")
    )
    return (
        slots.groupBy("user_id", "day", "slot")
        .agg(entry("plan").alias("plan_type"), entry("actual").alias("actual_type"))
        .withColumn("status", status)
    )


def goal_progress(slots: DataFrame, goal: float = GOAL_HOURS, goal_type: str = GOAL_TYPE) -> DataFrame:
    """Hours of the goal category per user and day, and the share of the goal reached."""
    hours = F.sum(F.when(F.col("type") == goal_type, SLOT_HOURS).otherwise(0.0))
    return (
        slots.where("kind = 'actual'")
        .groupBy("user_id", "day")
        .agg(F.coalesce(hours, F.lit(0.0)).alias("goal_hours"))
        .withColumn("progress", F.least(F.lit(1.0), F.col("goal_hours") / goal))
    )


def daily_focus(slots: DataFrame, goal_type: str = GOAL_TYPE) -> DataFrame:
    return (
        _recorded(slots)
        .groupBy("user_id", "day")
        .agg(
            (F.count("*") * SLOT_HOURS).alias("hours"),
            (F.count(F.when(F.col("type") == goal_type, 1)) * SLOT_HOURS).alias("goal_hours"),
        )
    )


def weekly_focus(slots: DataFrame, target: float = WEEKLY_TARGET) -> DataFrame:
    """Totals of each recorded day and the six calendar days before it.

    Slots are reduced to daily hours first; the window then reads one row per
    user and day.
    """
    daily = daily_focus(slots).withColumn("_n", F.unix_date("day"))
    week = Window.partitionBy("user_id").orderBy("_n").rangeBetween(-6, 0)
    total = F.sum("hours").over(week)
    return daily.select(
        "user_id", "day", total.alias("week_hours"),
        F.sum("goal_hours").over(week).alias("week_goal_hours"),
        (total < target).cast("int").alias("advise_start"),
    )


def focus_asof(slots: DataFrame, asof: dt.date, target: float = WEEKLY_TARGET) -> DataFrame:
    """The seven-day report of one day per user; only a week of slots is read."""
    first = asof - dt.timedelta(days=6)
    recent = slots.where(F.col("day").between(F.lit(first), F.lit(asof)))
    return (
        daily_focus(recent)
        .groupBy("user_id")
        .agg(F.sum("hours").alias("week_hours"), F.sum("goal_hours").alias("week_goal_hours"))
        .withColumn("advise_start", (F.col("week_hours") < target).cast("int"))
    )


def open_todos(todos: DataFrame, asof: dt.date) -> DataFrame:
    """One-off items, and daily items not yet done on the day."""
    done_today = F.col("last_done").eqNullSafe(F.lit(asof))
    return todos.where((F.col("type") != "daily") | ~done_today)


def open_todo_counts(todos: DataFrame, asof: dt.date) -> DataFrame:
    return open_todos(todos, asof).groupBy("user_id").agg(F.count("*").alias("open_items"))


def complete_todos(todos: DataFrame, completions: DataFrame) -> DataFrame:
    """To-dos after a batch of completions (todo_id, done_on).

    A daily item notes the last day it was done, a one-off item is removed.
    """
    done = completions.groupBy("todo_id").agg(F.max("done_on").alias("_done"))
    joined = todos.join(done, "todo_id", "left")
    return joined.where((F.col("type") == "daily") | F.col("_done").isNull()).select(
        *[
            F.coalesce("_done", "last_done").alias(c) if c == "last_done" else F.col(c)
            for c in todos.columns
        ]
    )
