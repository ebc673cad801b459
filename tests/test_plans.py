import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark import schemas
from pitspark.operators import quality as ql
from pitspark.plans import backtest, ingest, membership
from pitspark.session import materialize, shared_dir
from pitspark.sources import fundamentals as fund, seeds

D0 = dt.date(2016, 1, 4)


def line(day, px):
    return f"{day},{px},{px},{px + 1},{px - 1},100,{px * 100},2,0.5,0.1,1.5"


def lines(spark, rows):
    return spark.createDataFrame(rows, "code string, line string")


def alias(spark):
    return seeds.code_alias(spark)


def test_lines_landed_twice_are_one_bar(spark):
    rows = [("600001", line("2025-05-06", 7), 1), ("600001", line("2025-05-06", 8), 2), ("600001", line("2025-05-07", 9), 1)]
    twice = spark.createDataFrame(rows + rows[:1], "code string, line string, arrival int")
    universe = spark.createDataFrame([("600001",)], "code string")
    bars = ingest.primary_bars(twice, twice, alias(spark), universe).collect()
    assert sorted((str(r.trade_date), r.close_raw, r.prev_close_raw) for r in bars) == [
        ("2025-05-06", 8.0, None), ("2025-05-07", 9.0, 8.0)]


def test_archive_facts_take_the_first_listing_found(spark):
    universe = spark.createDataFrame([("920819",), ("600000",)], "code string")
    files = spark.createDataFrame(
        [("920819", 50, True), ("833819", 500, True), ("600000", 500, False)], "listing string, n_bytes int, parsed boolean")
    fields = [f"{f} string" for f in fund.ARCHIVE_FIELDS]
    record = ["833819", "2024-03-31", "2024-04-20", None, "Q1", "7", None, None, None, None]
    records = spark.createDataFrame([("833819", 1, *record), ("600000", 1, *record)], "listing string, arrival int, " + ", ".join(fields))
    batch = ingest.archive_facts(files, records, universe, alias(spark))
    assert [(r.code, r.revenue_cny) for r in batch.collect()] == [("920819", 7.0)]
    empty = spark.createDataFrame([], schemas.FINANCIAL_QUARTERLY)
    assert ingest.merge_facts(empty, batch, False, "arrival").count() == 1


def test_a_stopped_run_leaves_its_gate_report(spark, tmp_path):
    bars = spark.createDataFrame([], schemas.MARKET_DAILY)
    members = spark.createDataFrame([], schemas.MEMBERSHIP_HISTORY)
    facts = spark.createDataFrame([], schemas.FINANCIAL_QUARTERLY)
    with pytest.raises(ql.GateError):
        backtest.run_backtest(bars, members, facts, seeds.initial_jobs(spark), out_dir=str(tmp_path))
    assert spark.read.json(str(tmp_path / "gate")).first().formal_ok is False
    assert (tmp_path / "gate_missing").exists()


def test_shared_folder_is_required_off_local_mode():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_primary_ingest_stitches_and_merges(spark):
    raw = lines(spark, [
        ("833819", line("2025-05-05", 10)), ("833819", line("2025-05-06", 11)),
        ("920819", line("2025-05-06", 12)), ("600000", line("2025-05-06", 5)),
        ("600001", line("2025-05-06", 7)), ("600001", "2025-05-07,x,1,1,1,1,1,1,1,1,1"),
    ])
    adjusted = lines(spark, [("920819", line("2025-05-06", 24)), ("600000", line("2025-05-07", 9))])
    universe = spark.createDataFrame([("920819",), ("600001",)], "code string")
    batch = ingest.primary_bars(raw, adjusted, alias(spark), universe)
    assert batch.columns == schemas.MARKET_DAILY.fieldNames()
    rows = {str(r.trade_date): r for r in batch.collect()}
    # the payload of 600001 holds a malformed line and 600000 is not in the universe
    assert set(rows) == {"2025-05-05", "2025-05-06"}
    second = rows["2025-05-06"]
    assert (second.close_raw, second.close_qfq, second.prev_close_raw) == (12.0, 24.0, 10.0)
    assert rows["2025-05-05"].close_qfq is None and rows["2025-05-05"].prev_close_raw is None
    empty = spark.createDataFrame([], schemas.MARKET_DAILY)
    first = ingest.merge_bars(empty, batch, primary=True)
    archive = spark.createDataFrame(
        [(920819, "2025-05-06", 1.0, 2.0, 0.5, 99.0, None, 5.0, None, float("nan"))],
        "code int, date string, open double, high double, low double, close double, volume double, "
        "amount double, turn double, pctChg double")
    merged = ingest.merge_bars(first, ingest.archive_bars(archive), primary=False)
    row = merged.where("trade_date = date '2025-05-06'").first()
    assert (row.close_qfq, row.close_raw, row.volume_shares, row.amount_cny, row.pct_chg_pct) == (
        99.0, 12.0, 100.0, 5.0, 0.5)
    assert row.source_id == "S009" and merged.count() == 2
    jobs = ingest.report(seeds.initial_jobs(spark), "J001", batch, merged, "trade_date", universe)
    job = jobs.where("job_id = 'J001'").first()
    assert (job.status, job.loaded_entities, job.loaded_rows, job.target_entities) == ("FETCHED", 1, 2, 2)
    assert (job.min_date, job.max_date) == (dt.date(2025, 5, 5), dt.date(2025, 5, 6))
    failed = ingest.report(seeds.initial_jobs(spark), "J001", batch.limit(0), merged, "trade_date", universe)
    assert failed.where("job_id = 'J001'").first().status == "FAILED"
    with pytest.raises(ingest.IngestError):
        ingest.require_loaded(batch.limit(0))


def test_fundamentals_fall_back_to_the_other_listing(spark):
    body = '{"result":{"data":[{"REPORTDATE":"2024-03-31","NOTICE_DATE":"2024-04-20","YSTZ":"%s"}]}}'
    pages = spark.createDataFrame(
        [("920819", 1, '{"result":null}'), ("833819", 1, body % 7), ("600000", 1, body % 8)],
        "code string, page int, body string")
    universe = spark.createDataFrame([("920819",), ("600000",)], "code string")
    batch = ingest.primary_facts(pages, universe, alias(spark))
    assert {r.code: r.revenue_yoy_pct for r in batch.collect()} == {"920819": 7.0, "600000": 8.0}
    empty = spark.createDataFrame([], schemas.FINANCIAL_QUARTERLY)
    assert ingest.merge_facts(empty, batch, True, ["page", "pos"]).count() == 2


def landed(spark, codes):
    rows = [(f"{c}.SZ", "2015-01-01", "220303.0") for c in codes]
    return spark.createDataFrame(rows, "symbol string, start_date string, industry_code string")


def build(spark, codes):
    empty = {n: spark.createDataFrame([], s) for n, s in (
        ("raw", schemas.CLASSIFICATION_RAW), ("history", schemas.MEMBERSHIP_HISTORY),
        ("registry", schemas.SOURCE_REGISTRY))}
    return membership.build(
        landed(spark, codes), seeds.code_alias(spark), seeds.company_master(spark),
        seeds.initial_jobs(spark), empty["registry"], empty["raw"], empty["history"], dt.date(2026, 1, 21))


def test_membership_run(spark, tmp_path):
    codes = [r.code for r in seeds.company_master(spark).select("code").collect()]
    run = build(spark, codes)
    assert run.status == "LOADED" and run.history.count() == 33 and run.raw.count() == 33
    job = run.jobs.where("job_id = 'J003'").first()
    assert (job.status, job.target_entities, job.loaded_entities, job.max_date) == ("LOADED", 33, 33, None)
    assert run.registry.first().v1_status == "LOADED"
    membership.export(run, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "membership_audit")).count() == 33
    short = build(spark, codes[1:])
    assert short.status == "AUDIT_FAILED"
    with pytest.raises(membership.AuditError):
        membership.export(short, str(tmp_path / "failed"))


@pytest.fixture(scope="module")
def inputs(spark):
    """Two thousand days of three codes with a seasonal close."""
    days = spark.range(2000).select(F.date_add(F.lit(D0), F.col("id").cast("int")).alias("trade_date"), "id")
    codes = spark.createDataFrame([("000001", 0), ("000002", 40), ("000003", 90)], "code string, shift int")
    # every code trades on every day
    grid = days.withColumn("c", F.explode(F.array(F.lit(0), F.lit(40), F.lit(90)))).join(
        codes, F.col("c") == F.col("shift"))
    px = 10 + 2 * F.sin((F.col("id") + F.col("shift")) / 37) + (F.col("id") * 7919 % 101) / 400
    bars = grid.select("code", "trade_date", px.alias("close_qfq")).select(
        "*", F.col("close_qfq").alias("open_qfq"), (F.col("close_qfq") * 1.01).alias("high_qfq"),
        (F.col("close_qfq") * 0.99).alias("low_qfq"), F.lit(1.0).alias("volume_shares"),
        (F.col("close_qfq") * 3).alias("amount_cny"), F.col("close_qfq").alias("turnover_pct"),
        F.lit(1).alias("is_trade"))
    mem = codes.select("code", F.lit(D0).alias("in_date"), F.lit(None).cast("date").alias("out_date"))
    facts = codes.select(
        "code", F.lit(D0).alias("report_period"), F.lit(D0).alias("ann_date"),
        F.lit(D0).alias("available_date"), F.lit("0").alias("revision_id"),
        *[F.col("shift").cast("double").alias(c) for c in schemas.FIN])
    return materialize(bars, "bars"), mem, facts


def jobs_with(spark, status):
    return seeds.initial_jobs(spark).withColumn("status", F.lit(status))


def test_backtest_end_to_end(spark, inputs, tmp_path):
    result = backtest.run_backtest(*inputs, jobs_with(spark, "LOADED"))
    backtest.write_results(result, str(tmp_path))
    report = spark.read.json(str(tmp_path / "backtest_summary")).first()
    assert report.status == "FORMAL" and report.panel_rows == 6000 and report.panel_codes == 3
    assert report.gate.formal_ok and len(report.aggregate) == result.overall.count() > 0
    for name in ("pit_panel", "walk_forward_metrics_by_year", "walk_forward_predictions"):
        assert spark.read.option("header", True).csv(str(tmp_path / name)).count() > 0


def test_gate(spark, inputs):
    bars, mem, facts = inputs
    with pytest.raises(ql.GateError):
        backtest.run_backtest(bars, mem, facts, jobs_with(spark, "FETCHED"))
    few = bars.where("trade_date < date '2020-01-01'")
    report = ql.gate_report(mem, few, jobs_with(spark, "LOADED"), min_bars=few.count()).first()
    assert not report.formal_ok  # strictly more rows are needed
    extra = mem.unionByName(mem.limit(1).withColumn("code", F.lit("999999")))
    report = ql.gate_report(extra, bars, jobs_with(spark, "LOADED")).first()
    assert report.missing_codes == 1 and report.run_status == "PARTIAL"
    assert [r.code for r in ql.gate_missing(extra, bars).collect()] == ["999999"]
    with pytest.raises(ql.GateError):
        ql.enforce_gate(ql.gate_report(mem, bars.limit(0), jobs_with(spark, "LOADED")), True)
    assert ql.gate_report(mem, bars, jobs_with(spark, "LOADED").limit(0)).first().job_status is None


def test_shared_dir_is_read_from_the_session(spark):
    class Conf:
        def get(self, key, default):
            return {"spark.checkpoint.dir": "hdfs://shared/ckpt/"}.get(key, default)

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "hdfs://shared/ckpt"
    assert shared_dir(spark) == shared_dir(spark)


def test_source_entry_replaces_its_row(spark):
    empty = spark.createDataFrame([], schemas.SOURCE_REGISTRY)
    once = ingest.source_entry(empty, "S014", "market_daily", "archive", "u", "2020 on", "PARQUET", "MEDIUM", "FALLBACK", "n")
    twice = ingest.source_entry(once, "S014", "market_daily", "archive", "u", "2021 on", "PARQUET", "MEDIUM", "FALLBACK", "n")
    assert [(r.source_id, r[4]) for r in twice.collect()] == [("S014", "2021 on")]


def test_the_same_lines_of_both_bases_are_read_once(spark, monkeypatch):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).cast("string")
    lines = spark.range(9).select(
        F.lit("000001").alias("code"), F.concat_ws(",", day, F.repeat(F.lit("1.5,"), F.lit(9)), F.lit("2")).alias("line"))
    lines = lines.withColumn("line", F.replace("line", F.lit(",,"), F.lit(",")))
    universe = spark.createDataFrame([("000001",)], "code string")
    none = spark.createDataFrame([], "canonical_code string, historical_code string, valid_from date, valid_to date, alias_rank int")
    bars = ingest.primary_bars(lines, lines, none, universe)
    assert "Range" not in bars._jdf.queryExecution().optimizedPlan().toString()
    rows = bars.collect()
    assert len(rows) == 9 and all(r.close_raw == r.close_qfq == 1.5 for r in rows)
