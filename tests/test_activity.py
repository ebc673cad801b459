import datetime as dt
import random

from pitspark.operators import activity as ac

D = dt.date(2024, 1, 10)


def slots(spark, rows):
    return spark.createDataFrame(rows, "user_id int, kind string, day date, slot int, type string")


def test_paint_equals_replay(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.choice(["plan", "actual"]), D, rnd.randrange(48), rnd.randrange(48),
             rnd.choice(["bud", "wood", "empty"]), i) for i in range(60)]
    state = {}
    for u, k, d, s, e, t, _ in rows:
        for slot in range(min(s, e), max(s, e) + 1):
            state[u, k, d, slot] = t
    df = spark.createDataFrame(rows, "user_id int, kind string, day date, start_slot int, end_slot int, type string, paint_order int")
    got = {(r.user_id, r.kind, r.day, r.slot): r.type for r in ac.paint_slots(df).collect()}
    assert got == state


def test_status_hours_goal_and_holes(spark):
    rows = [(1, "plan", D, 0, "bud"), (1, "actual", D, 0, "bud"), (1, "plan", D, 1, "bud"),
            (1, "actual", D, 2, "wood"), (1, "actual", D, 3, "empty"), (1, "actual", D, 4, None),
            (1, "plan", D, 2, "empty")]
    df = slots(spark, rows)
    got = {r.slot: r.status for r in ac.plan_vs_actual(df).collect()}
    assert got == {0: "resonance", 1: "planned", 2: "recorded", 3: "empty", 4: "empty"}
    assert {r.type: r.hours for r in ac.hours_by_type(df).collect()} == {"bud": 0.5, "wood": 0.5}
    goal = ac.goal_progress(df).first()
    assert (goal.goal_hours, goal.progress) == (0.5, 0.0625)


def test_goal_is_capped_and_week_reaches_back_six_days(spark):
    rows = [(1, "actual", D, s, "bud") for s in range(20)]
    rows += [(1, "actual", D + dt.timedelta(days=6), 0, "wood"), (1, "actual", D + dt.timedelta(days=7), 0, "wood")]
    df = slots(spark, rows)
    assert ac.goal_progress(df).where("progress = 1.0").count() == 1
    week = {r.day: r for r in ac.weekly_focus(df).collect()}
    assert [week[D + dt.timedelta(days=n)].week_hours for n in (0, 6, 7)] == [10.0, 10.5, 1.0]
    assert [week[D + dt.timedelta(days=n)].advise_start for n in (0, 7)] == [0, 1]
    report = ac.focus_asof(df, D + dt.timedelta(days=6)).first()
    assert (report.week_hours, report.week_goal_hours, report.advise_start) == (10.5, 10.0, 0)


def test_todos(spark):
    rows = [(1, 9, "once", D, D), (2, 9, "daily", D, D), (3, 9, "daily", D, None), (4, 9, "once", D, None)]
    df = spark.createDataFrame(rows, "todo_id int, user_id int, type string, created date, last_done date")
    assert sorted(r.todo_id for r in ac.open_todos(df, D).collect()) == [1, 3, 4]
    assert ac.open_todo_counts(df, D).first().open_items == 3
    later = D + dt.timedelta(days=1)
    done = spark.createDataFrame([(3, D), (3, later), (4, D)], "todo_id int, done_on date")
    left = {r.todo_id: r.last_done for r in ac.complete_todos(df, done).collect()}
    assert left == {1: D, 2: D, 3: later}
