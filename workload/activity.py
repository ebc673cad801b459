"""Half-hour slots and to-dos."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from pitspark.functions.scalars import slot_label, slot_of
from pitspark.operators import activity as ac
from pitspark.sources.slots import read_slot_arrays, read_todo_arrays

from .fixtures import Tables
from .registry import query

ASOF = dt.date(2024, 1, 30)
RECORDED = "FROM fx_slots WHERE kind = 'actual' AND type <> 'empty'"
DAILY_SQL = f"""
  SELECT user_id, day, count(*) * 0.5 AS hours,
    count(*) FILTER (WHERE type = 'bud') * 0.5 AS goal_hours {RECORDED} GROUP BY user_id, day"""


def slots_of(t: Tables) -> DataFrame:
    return ac.paint_slots(t.paint())


@query("activity_paint", "SELECT user_id, kind, day, slot, type FROM fx_slots", ["fx_slots"])
def paint(t: Tables) -> DataFrame:
    return slots_of(t)


@query(
    "activity_hours",
    f"""SELECT user_id, day, type, CAST(count(*) * 0.5 AS DOUBLE) AS hours {RECORDED}
        GROUP BY user_id, day, type""",
    ["fx_slots"],
)
def hours(t: Tables) -> DataFrame:
    return ac.hours_by_type(slots_of(t))


@query(
    "plan_vs_actual",
    """SELECT user_id, day, slot, p AS plan_type, a AS actual_type,
         CASE WHEN a IS NOT NULL AND a = p THEN 'resonance' WHEN a IS NOT NULL THEN 'recorded'
           WHEN p IS NOT NULL THEN 'planned' ELSE 'empty' END AS status
       FROM (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.day, y.day) AS day,
               coalesce(x.slot, y.slot) AS slot, nullif(x.type, 'empty') AS p,
               nullif(y.type, 'empty') AS a
             FROM (SELECT * FROM fx_slots WHERE kind = 'plan') x
             FULL OUTER JOIN (SELECT * FROM fx_slots WHERE kind = 'actual') y
               ON x.user_id = y.user_id AND x.day = y.day AND x.slot = y.slot)""",
    ["fx_slots"],
)
def plan_vs_actual(t: Tables) -> DataFrame:
    return ac.plan_vs_actual(slots_of(t))


@query(
    "goal_progress",
    """SELECT user_id, day, CAST(h AS DOUBLE) AS goal_hours,
         CAST(least(1.0, h / 8) AS DOUBLE) AS progress
       FROM (SELECT user_id, day, count(*) FILTER (WHERE type = 'bud') * 0.5::DOUBLE AS h
             FROM fx_slots WHERE kind = 'actual' GROUP BY user_id, day)""",
    ["fx_slots"],
)
def goal(t: Tables) -> DataFrame:
    return ac.goal_progress(slots_of(t))


@query(
    "weekly_focus",
    """SELECT a.user_id, a.day, CAST(sum(b.hours) AS DOUBLE) AS week_hours,
         CAST(sum(b.goal_hours) AS DOUBLE) AS week_goal_hours,
         CASE WHEN sum(b.hours) < 10 THEN 1 ELSE 0 END AS advise_start
       FROM daily a JOIN daily b
         ON a.user_id = b.user_id AND b.day BETWEEN a.day - 6 AND a.day
       GROUP BY a.user_id, a.day""",
    ["fx_slots"], {"daily": DAILY_SQL},
)
def weekly(t: Tables) -> DataFrame:
    return ac.weekly_focus(slots_of(t))


@query(
    "focus_asof",
    f"""SELECT user_id, CAST(sum(hours) AS DOUBLE) AS week_hours,
          CAST(sum(goal_hours) AS DOUBLE) AS week_goal_hours,
          CASE WHEN sum(hours) < 10 THEN 1 ELSE 0 END AS advise_start
        FROM daily WHERE day BETWEEN DATE '{ASOF}' - 6 AND DATE '{ASOF}' GROUP BY user_id""",
    ["fx_slots"], {"daily": DAILY_SQL},
)
def focus(t: Tables) -> DataFrame:
    return ac.focus_asof(slots_of(t), ASOF)


@query(
    "slot_labels",
    """SELECT event_id,
         CAST(extract(HOUR FROM ts) * 2 + floor(extract(MINUTE FROM ts) / 30) AS INTEGER) AS slot,
         concat(extract(HOUR FROM ts), CASE WHEN extract(MINUTE FROM ts) < 30 THEN ':00'
           ELSE ':30' END) AS label
       FROM events""",
)
def labels(t: Tables) -> DataFrame:
    slots = t.read("events").select("event_id", slot_of(F.col("ts")).alias("slot"))
    return slots.withColumn("label", slot_label(F.col("slot")))


def slot_arrays_of(t: Tables) -> DataFrame:
    """Day arrays as they are stored: 48 texts at most, holes as JSON null."""
    entry = F.map_from_entries(F.collect_list(F.struct("slot", "type")))
    texts = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("m", i))
    return (
        slots_of(t)
        .groupBy("user_id", "kind", "day")
        .agg(entry.alias("m"), F.max("slot").alias("last"))
        .select("user_id", "kind", "day", F.to_json(texts).alias("slots"))
    )


@query(
    "slot_arrays",
    "SELECT user_id, kind, day, slot, type FROM fx_slots WHERE type <> 'empty'", ["fx_slots"],
)
def slot_arrays(t: Tables) -> DataFrame:
    return read_slot_arrays(slot_arrays_of(t))


@query(
    "todo_arrays",
    """SELECT user_id, todo_id, type, created, last_done FROM fx_todos""", ["fx_todos"],
)
def todo_arrays(t: Tables) -> DataFrame:
    """Lists are stored per user and creation day, at most a hundred items each."""
    def millis(day: str):
        return F.unix_millis(F.col(day).cast("timestamp"))

    item = F.struct(
        F.col("todo_id").cast("string").alias("text"), "type",
        millis("created").alias("created"), millis("last_done").alias("lastDone"),
    )
    part = F.floor(F.col("todo_id") / 100)
    lists = t.todos().groupBy("user_id", "created", part).agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("todos")
    )
    return read_todo_arrays(lists.select("user_id", "todos")).select(
        "user_id", F.col("text").cast("long").alias("todo_id"), "type", "created", "last_done"
    )


OPEN_SQL = f"""
  SELECT todo_id, user_id, type, created, last_done FROM fx_todos
  WHERE type <> 'daily' OR last_done IS NULL OR last_done <> DATE '{ASOF}'"""


@query("open_todos", OPEN_SQL, ["fx_todos"])
def open_todos(t: Tables) -> DataFrame:
    return ac.open_todos(t.todos(), ASOF)


@query(
    "open_todo_counts", "SELECT user_id, count(*) AS open_items FROM o GROUP BY user_id",
    ["fx_todos"], {"o": OPEN_SQL},
)
def open_counts(t: Tables) -> DataFrame:
    return ac.open_todo_counts(t.todos(), ASOF)


@query(
    "complete_todos",
    """SELECT t.todo_id, t.user_id, t.type, t.created, coalesce(d.done, t.last_done) AS last_done
       FROM fx_todos t LEFT JOIN (SELECT todo_id, max(done_on) AS done FROM done GROUP BY todo_id) d
         ON d.todo_id = t.todo_id
       WHERE t.type = 'daily' OR d.todo_id IS NULL""",
    ["fx_todos"],
    {
        "done": """
  SELECT todo_id, created + 2 AS done_on FROM fx_todos WHERE last_done IS NOT NULL
  UNION ALL SELECT todo_id, created + 1 FROM fx_todos WHERE last_done IS NOT NULL"""
    },
)
def complete(t: Tables) -> DataFrame:
    """Every item that was done before is ticked off twice more."""
    done = t.todos().where("last_done is not null").select(
        "todo_id", F.explode(F.array(F.date_add("created", 2), F.date_add("created", 1)))
        .alias("done_on"),
    )
    return ac.complete_todos(t.todos(), done)
