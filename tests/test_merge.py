import random

import pytest
from pyspark.sql import functions as F

from pitspark.operators import merge as mg
from pitspark.operators.aliases import alias_stitch, first_source
from pitspark.sources import sinks

POLICY = {"a": mg.OVERWRITE, "b": mg.COALESCE, "c": mg.INSERT_ONLY}
SCHEMA = "k int, a string, b double, c int"


def row_by_row(target, batch):
    state = {r[0]: list(r) for r in target}
    for r in sorted(batch, key=lambda r: r[4]):
        if r[0] not in state:
            state[r[0]] = list(r[:4])
            continue
        old = state[r[0]]
        old[1] = r[1]
        old[2] = r[2] if r[2] is not None else old[2]
    return sorted(tuple(r) for r in state.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_row_by_row(spark, seed):
    rnd = random.Random(seed)

    def value(v):
        return None if rnd.random() < 0.3 else v

    target = [(k, value(f"t{k}"), value(k * 1.0), value(k)) for k in range(0, 40, 2)]
    batch = [(rnd.randrange(40), value(f"b{i}"), value(i * 1.5), value(i), i) for i in range(120)]
    t = spark.createDataFrame(target, SCHEMA)
    b = spark.createDataFrame(batch, SCHEMA + ", n int")
    want = row_by_row(target, batch)
    got = mg.merge_upsert(t, b, ["k"], POLICY, "n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    touched = mg.merge_touched(t, b, ["k"], POLICY, "n", F.floor(F.col("k") / 10))
    assert sorted(map(tuple, touched.collect()), key=str) == sorted(want, key=str)
    again = mg.merge_upsert(got, b, ["k"], POLICY, "n")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)


def test_overwrite_sets_null_and_columns_absent_from_the_batch_stay(spark):
    t = spark.createDataFrame([(1, "x", 1.0, 7)], SCHEMA)
    b = spark.createDataFrame([(1, None, None)], "k int, a string, b double")
    assert tuple(mg.merge_upsert(t, b, ["k"], POLICY).first()) == (1, None, 1.0, 7)


def test_unknown_policy(spark):
    b = spark.createDataFrame([(1, "x", 1)], "k int, a string, n int")
    with pytest.raises(ValueError):
        mg.collapse_batch(b, ["k"], {"a": "sum"}, "n")


def test_replace_ignore_and_source(spark, tmp_path):
    t = spark.createDataFrame([(1, "x", "old"), (2, "y", "old")], "k int, v string, note string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, mg.insert_or_replace(t, b, ["k"]).collect())) == [
        (1, "x", "old"), (2, "z", None), (3, "w", None)]
    ignored = mg.insert_ignore(t.drop("note"), b, ["k"]).collect()
    assert sorted(map(tuple, ignored)) == [(1, "x"), (2, "y"), (3, "w")]
    s = spark.createDataFrame([(1, "A"), (2, "B")], "v int, source_id string")
    fresh = spark.createDataFrame([(9, "A")], "v int, source_id string")
    assert sorted(map(tuple, mg.replace_source(s, fresh, "A").collect())) == [(2, "B"), (9, "A")]
    assert mg.replace_source(s, fresh.limit(0), "A").count() == 1
    path = str(tmp_path / "by_source")
    sinks.overwrite_sources(s, path)
    sinks.overwrite_sources(fresh, path)
    assert sorted((r.v, r.source_id) for r in spark.read.parquet(path).collect()) == [(2, "B"), (9, "A")]


def test_alias_cut_over(spark):
    bars = spark.createDataFrame(
        [("833819", "2025-05-05", 1.0), ("833819", "2025-05-06", 2.0), ("920819", "2025-05-05", 3.0),
         ("920819", "2025-05-06", 4.0), ("600000", "2025-05-06", 5.0)],
        "code string, d string, px double").withColumn("trade_date", F.to_date("d")).drop("d")
    alias = spark.createDataFrame(
        [("920819", "833819", None, "2025-05-05", 1), ("920819", "920819", "2025-05-06", None, 2)],
        "canonical_code string, historical_code string, f string, t string, alias_rank int",
    ).select("*", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    got = sorted((r.code, str(r.trade_date), r.px) for r in alias_stitch(bars, alias).collect())
    # the bare historical listing passes as a code of its own as well
    assert got == [("600000", "2025-05-06", 5.0), ("833819", "2025-05-05", 1.0),
                   ("833819", "2025-05-06", 2.0), ("920819", "2025-05-05", 1.0),
                   ("920819", "2025-05-06", 4.0)]
    open_end = alias.withColumn("valid_to", F.lit(None).cast("date"))
    late = {(r.code, str(r.trade_date)): r.px for r in alias_stitch(bars, open_end).collect()}
    assert late["920819", "2025-05-06"] == 4.0


def test_first_source_with_accepted_file_without_rows(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 2, 30)], "code string, rank int, v int")
    assert sorted(r.v for r in first_source(rows, "code", "rank").collect()) == [10, 30]
    files = spark.createDataFrame([("a", 0), ("b", 2)], "code string, rank int")
    assert [r.v for r in first_source(rows, "code", "rank", files).collect()] == [30]


def test_null_slice_and_null_keys_lose_nothing(spark):
    target = spark.createDataFrame([(1, 1.0), (11, 2.0), (21, 3.0), (None, 4.0)], "k int, v double")
    batch = spark.createDataFrame([(11, 9.0), (None, 8.0)], "k int, v double")
    part = F.floor(F.col("k") / 10)
    got = mg.merge_touched(target, batch, ["k"], {"v": mg.OVERWRITE}, None, part)
    assert sorted((r.k is None, r.k or 0, r.v) for r in got.collect()) == [
        (False, 1, 1.0), (False, 11, 9.0), (False, 21, 3.0), (True, 0, 4.0), (True, 0, 8.0)]
    assert mg.with_keys(batch, ["k"]).count() == 1 and mg.without_keys(batch, ["k"]).count() == 1


def test_a_repeated_key_without_order_is_an_error(spark):
    target = spark.createDataFrame([(1, 1.0)], "k int, v double")
    batch = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(Exception, match="repeats a key"):
        mg.merge_upsert(target, batch, ["k"], {"v": mg.OVERWRITE}).collect()


def test_a_batch_carries_its_order_few_times(spark):
    columns = ", ".join(f"id as c{i}" for i in range(12))
    batch = spark.sql(f"select id % 3 as k, id as at, {columns} from range(9)").withColumn("c0", F.when(F.col("at") < 5, F.col("at")))
    policy = {"c0": mg.COALESCE} | {f"c{i}": mg.OVERWRITE for i in range(1, 6)}
    merged = mg.collapse_batch(batch, ["k"], policy, "at")
    text = merged._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("max_by(") == 2 and text.count("min_by(") == 1
    got = {r.k: (r.c0, r.c1, r.c5, r.c6, r.c11) for r in merged.collect()}
    assert got == {0: (3, 6, 6, 0, 0), 1: (4, 7, 7, 1, 1), 2: (2, 8, 8, 2, 2)}
