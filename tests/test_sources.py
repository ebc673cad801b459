import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitspark.functions import scalars as sc
from pitspark.schemas import COMPANY_MASTER
from pitspark.sources import bars as bs, fundamentals as fn, seeds, sinks
from pitspark.sources.classification import normalise_history, read_history
from pitspark.sources.landing import EmptySourceError
from pitspark.sources.slots import read_slot_arrays, read_todo_arrays
from pitspark.sources.universe import read_universe


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, sc.pad_code(F.col("c")), c="42") == "000042"
    assert one(spark, sc.pad_code(F.col("c")), c="12345678") == "12345678"
    for code, want in (("600001", "SH"), ("688001", "SH"), ("920001", "BJ"), ("430001", "BJ"),
                       ("830001", "BJ"), ("870001", "BJ"), ("000001", "SZ")):
        assert one(spark, sc.exchange_of(F.col("c")), c=code) == want
    both = sc.exchange_or_derived(F.col("e"), F.col("c"))
    assert one(spark, both, e="bj", c="600001") == "BJ"
    assert one(spark, both, e="", c="600001") == "SH"
    for text, want in (("2024-03-31 00:00:00", dt.date(2024, 3, 31)), ("2024", None), ("n/a", None),
                       ("", None), ("2024-13-01", None)):
        assert one(spark, sc.date_prefix(F.col("d")), d=text) == want
    for text, want in (("1.5", 1.5), ("-", None), ("", None), ("NaN", None), ("1.5d", None),
                       (" 2 ", 2.0), ("1e3", 1000.0), ("x", None), (None, None)):
        assert one(spark, sc.to_number(F.col("n")), n=text) == want
    assert one(spark, sc.first_number(F.col("a"), F.col("b")), a="-", b="2") == 2.0
    assert one(spark, sc.first_text(F.col("a"), F.col("b")), a="", b=None) == ""
    assert one(spark, sc.classification_version(F.col("c")), c="220303->220803") == "SW2021"
    assert one(spark, sc.decide(F.col("p").cast("double")), p="0.5") == 1
    assert one(spark, sc.slot_label(F.col("s").cast("int")), s="47") == "23:30"
    got = spark.sql("select date'2024-01-02' a, date'2024-01-03' u, cast(null as date) z")
    row = got.select(sc.availability_date(F.col("a"), F.col("z")), sc.revision_id(F.col("a"), F.col("u")),
                     sc.revision_id(F.col("z"), F.col("z")), sc.inclusive_end(F.col("z"))).first()
    assert tuple(row) == (dt.date(2024, 1, 2), "2024-01-03", "0", None)


def test_universe_csv_with_mark_and_duplicates(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes("﻿code,name,exchange\n000001,first,\n 000001 ,second,bj\n,blank,\n600002,,sh\n".encode())
    first = {r.code: (r.exchange, r.name) for r in read_universe(spark, str(path)).collect()}
    last = {r.code: (r.exchange, r.name) for r in read_universe(spark, str(path), "last").collect()}
    assert first == {"000001": ("SZ", "first"), "600002": ("SH", "")}
    assert last["000001"] == ("BJ", "second")
    with pytest.raises(ValueError):
        read_universe(spark, str(path), "any")


def test_universe_order_spans_files(spark, tmp_path):
    for i, name in enumerate(["late", "early"]):
        (tmp_path / f"{1 - i}.csv").write_text(f"code,name\n000001,{name}\n")
    got = read_universe(spark, str(tmp_path)).first()
    assert got.name == "early"


def test_bar_archive(spark, tmp_path):
    rows = [("1", "2020-01-02", 1.0), ("000001", "2020-01-03", 2.0), ("000002", "2020-01-03", 3.0)]
    df = spark.createDataFrame(rows, "code string, date string, close double")
    df.write.parquet(str(tmp_path / "kline_a.parquet"))
    universe = spark.createDataFrame([("1",)], "code string")
    got = bs.scan_bar_archive(spark, str(tmp_path / "kline_*.parquet"), universe)
    assert sorted((r.code, r.close) for r in got.collect()) == [("000001", 1.0), ("000001", 2.0)]
    with pytest.raises(EmptySourceError):
        bs.read_bar_archive(spark, str(tmp_path / "kline_*.parquet"), universe.where("code = 'x'"))
    with pytest.raises(Exception):
        bs.read_bar_archive(spark, str(tmp_path / "none_*.parquet"), universe)


def test_integer_codes_match_and_no_job_runs_while_the_plan_is_built(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-02"), (2, "2020-01-02")], "code int, date string")
    df.write.parquet(str(tmp_path / "kline_a.parquet"))
    schema = spark.read.parquet(str(tmp_path / "kline_*")).schema
    spark.sparkContext.setJobGroup("scan-plan", "")
    rows = [("000001",), ("",), ("٣",)]
    got = bs.scan_bar_archive(spark, str(tmp_path / "kline_*"), spark.createDataFrame(rows, "code string"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("scan-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert schema["code"].dataType.typeName() == "integer" and len(jobs) <= 1  # the footer's schema at most
    assert [r.code for r in got.collect()] == ["000001"]


def test_files_are_read_under_their_own_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("code,name\n000001,one\n")
    (tmp_path / "2.csv").write_text("name,exchange,code\ntwo,sz,000002\n")
    got = {r.code: (r.name, r.exchange) for r in read_universe(spark, str(tmp_path)).collect()}
    assert got == {"000001": ("one", "SZ"), "000002": ("two", "SZ")}


def test_unreadable_dates_are_malformed_and_nan_is_missing(spark):
    good = "2020-01-02,1,2,3,0.5,100,200,5,1.5,0.1,0.7"
    rows = [("a", good), ("a", good.replace(",1.5,", ",nan,")), ("b", good.replace("2020-01-02", "soon"))]
    parsed = bs.parse_kline_lines(spark.createDataFrame(rows, "code string, line string"))
    assert sorted((r.code, r.malformed) for r in parsed.collect()) == [("a", False), ("a", False), ("b", True)]
    assert parsed.where("pct is null and code = 'a'").count() == 1


def test_kline_lines(spark):
    good = "2020-01-02,1,2,3,0.5,100,200,5,1.5,0.1,0.7,extra"
    rows = [("a", good), ("a", "2020-01-03,1,2"), ("b", good), ("b", good.replace(",2,", ",x,"))]
    parsed = bs.parse_kline_lines(spark.createDataFrame(rows, "code string, line string"))
    assert parsed.count() == 3
    clean = bs.quarantine_payloads(parsed, ["code"]).collect()
    assert [(r.code, r.open, r.close, r.turnover) for r in clean] == [("a", 1.0, 2.0, 0.7)]


def test_fundamental_pages(spark):
    def record(**kw):
        return {"REPORTDATE": "2024-03-31 00:00:00", "NOTICE_DATE": "2024-04-20", **kw}

    pages = [
        ("000001", 1, json.dumps({"result": {"pages": 2, "data": [
            record(YSTZ="-", TOTAL_OPERATE_INCOME_YOY="3.5", DATATYPE="", QDATE="2024Q1"),
            record(YSTZ="9"), record(REPORTDATE=None)]}})),
        ("000001", 2, json.dumps({"result": {"data": [record(UPDATE_DATE="2024-05-01", YSTZ="4")]}})),
        ("000002", 1, json.dumps({"result": None})), ("000003", 1, json.dumps({"result": {"data": []}})),
    ]
    df = spark.createDataFrame(pages, "code string, page int, body string")
    records = fn.parse_fundamental_pages(df)
    assert records.count() == 4
    got = {r.revision_id: r for r in fn.normalise_primary(records).collect()}
    assert set(got) == {"2024-04-20", "2024-05-01"}
    assert (got["2024-04-20"].revenue_yoy_pct, got["2024-04-20"].report_type) == (3.5, "2024Q1")
    assert got["2024-05-01"].available_date == dt.date(2024, 5, 1)
    assert got["2024-05-01"].ann_date == dt.date(2024, 4, 20)


def test_classification(spark):
    df = spark.createDataFrame([("1.SZ", "2020-01-01", " 220303.0 ")], "symbol string, start_date string, industry_code string")
    assert tuple(normalise_history(df).first()) == ("000001", dt.date(2020, 1, 1), "220303")
    with pytest.raises(EmptySourceError):
        read_history(df.limit(0))


def test_seeds(spark):
    master = seeds.company_master(spark)
    assert master.columns == COMPANY_MASTER.fieldNames() and master.count() == 33
    row = master.where("code = '002496'").first()
    assert (row.company_id, row.board, row.status_name) == ("CN.SZ.002496", "深市主板", "ST")
    assert master.where("board is null").count() == 0
    assert seeds.code_alias(spark).count() == 4
    assert seeds.snapshot_membership(master).count() == 33
    assert seeds.initial_jobs(spark).count() == 3 and seeds.initial_meta(spark).count() == 3


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x,y")], "a int, b string")
    back = spark.read.option("header", True).csv(sinks.write_csv(df, str(tmp_path / "c")))
    assert sorted((r.a, r.b) for r in back.collect()) == [("1", None), ("2", "x,y")]
    path = sinks.write_json(df.select(F.struct("a", "b").alias("s")), str(tmp_path / "j"))
    assert sorted(spark.read.json(path).select("s.a").toPandas().a) == [1, 2]


def test_slot_and_todo_arrays(spark):
    days = spark.createDataFrame(
        [(1, '["bud","empty",null,"wood"]'), (2, None), (3, "[]"), (4, json.dumps(["bud"] * 48))],
        "user_id int, slots string")
    got = read_slot_arrays(days)
    assert sorted((r.slot, r.type) for r in got.where("user_id = 1").collect()) == [(0, "bud"), (3, "wood")]
    assert got.where("user_id in (2, 3)").count() == 0 and got.where("user_id = 4").count() == 48
    todos = spark.createDataFrame(
        [('[{"text":"a","type":"daily","created":1706572800000},{"text":"b","type":"once","created":0,"lastDone":86400000}]',)],
        "todos string")
    rows = read_todo_arrays(todos).collect()
    assert [(r.position, r.text, r.created, r.last_done) for r in rows] == [
        (0, "a", dt.date(2024, 1, 30), None), (1, "b", dt.date(1970, 1, 1), dt.date(1970, 1, 2))]


def test_a_day_of_too_many_slots_is_an_error(spark):
    days = spark.createDataFrame([(1, json.dumps(["bud"] * 48)), (2, json.dumps(["bud"] * 49))], "user_id int, slots string")
    assert read_slot_arrays(days.where("user_id = 1")).count() == 48
    with pytest.raises(Exception, match="48 slots"):
        read_slot_arrays(days).collect()


def test_a_quarantine_parses_its_lines_once(spark):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).cast("string")
    numbers = F.concat_ws(",", *[F.lit("1.5")] * 9)
    lines = spark.range(40).select(
        (F.col("id") % 4).cast("string").alias("code"),
        F.concat_ws(",", day, numbers, F.when(F.col("id") == 6, "-").otherwise("nan")).alias("line"))
    clean = bs.quarantine_payloads(bs.parse_kline_lines(lines), ["code"])
    text = clean._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in text and "try_to_date" not in text and "Range" not in text
    rows = clean.collect()
    assert len(rows) == 30 and {r.code for r in rows} == {"0", "1", "3"}
    assert all(r.turnover is None and r.open == 1.5 and r.date.year == 2020 for r in rows)
