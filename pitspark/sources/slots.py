"""Half-hour slot arrays and to-do lists stored as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import EMPTY_SLOT, SLOTS_PER_DAY, TODO_ARRAY


def read_slot_arrays(days: DataFrame, slots: str = "slots") -> DataFrame:
    """One row per filled slot of each day array.

    A missing array, a hole and the clear marker all mean an empty slot and
    yield no row. A day has 48 slots: a longer array is an error, since its further slots stand for no time.
    """
    keep = [c for c in days.columns if c != slots]
    return (
        days.select(*keep, F.posexplode(F.from_json(slots, "array<string>")).alias("slot", "type"))
        .where(F.when(F.col("slot") < SLOTS_PER_DAY, F.col("type") != EMPTY_SLOT).otherwise(
            F.raise_error(F.lit(f"a day has {SLOTS_PER_DAY} slots")).cast("boolean")))
    )


def read_todo_arrays(lists: DataFrame, todos: str = "todos") -> DataFrame:
    """One row per to-do with its place in the list; epoch milliseconds become dates."""
    keep = [c for c in lists.columns if c != todos]
    return (
        lists.select(*keep, F.posexplode(F.from_json(todos, TODO_ARRAY)).alias("position", "_t"))
        .select(
            *keep, "position", "_t.text", "_t.type",
            F.to_date(F.timestamp_millis("_t.created")).alias("created"),
            F.to_date(F.timestamp_millis("_t.lastDone")).alias("last_done"),
        )
    )
