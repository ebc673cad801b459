"""Archives by file, versioned tables, accounts of lines and pages, ordered exports."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from pitspark import schemas
from pitspark.operators import landed as ld, merge as mg
from pitspark.plans import ingest
from pitspark.sources import archive, bars as bar_source, landing, seeds, sinks, versions

HEADER = "SECURITY_CODE,REPORT_DATE,NOTICE_DATE,UPDATE_DATE,REPORT_TYPE,TOTAL_OPERATE_INCOME"


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


# --- archive files

def test_archive_files_by_size_and_readability(spark, tmp_path):
    row = "600000,2024-03-31,2024-04-20,,Q1,7\n"
    files = {
        "SH600000.csv": HEADER + "\n" + row * 3, "SH600001.csv": "no\n", "SH600002.csv": HEADER + "\n" + row + "1,2,3,4,5,6,7\n",
        "SH600003.csv": HEADER + "\n", "SZ000004.csv": b"", "SZ000005.csv": HEADER.encode() + b"\n\xff\xfe,2,3\n",
        "SZ000006.csv": HEADER + '\n"a,b,c",2,3\n', "notes.csv": HEADER + "\n", "S Z+%20[1]000007.csv": HEADER + "\n" + row,
    }
    for name, text in files.items():
        write(tmp_path / name, text)
    got = {r.listing: (r.n_bytes, r.parsed) for r in archive.archive_files(spark, str(tmp_path)).collect() if r.listing}
    assert {k: p for k, (_, p) in got.items()} == {
        "600000": True, "600001": True, "600002": False, "600003": True, "000005": False, "000006": True, "000007": True}
    assert got["600000"][0] == len(files["SH600000.csv"])
    assert archive.archive_files(spark, str(tmp_path)).count() == len(files) - 1


@pytest.mark.parametrize("name", ["a b.csv", "a[1].csv", "a%20b.csv", "a{x},+é.csv", "plain.csv"])
def test_csv_files_of_any_name_are_read(spark, tmp_path, name):
    write(tmp_path / name, "code,name\n1,x\n2,y\n")
    write(tmp_path / "other.csv", "name,code\nz,3\n")
    rows = landing.read_csv_by_header(spark, str(tmp_path)).select("code", "name").collect()
    assert sorted(map(tuple, rows)) == [("1", "x"), ("2", "y"), ("3", "z")]


def test_a_small_universe_reads_a_small_part_of_the_archive(spark, tmp_path):
    codes = spark.range(1000).select(F.col("id").cast("string").alias("code"))
    bars = codes.crossJoin(spark.range(20).withColumnRenamed("id", "d")).select(
        "code", F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("d").cast("int")).alias("date"), F.col("d").cast("double").alias("close"))
    path = bar_source.write_clustered_archive(bars, str(tmp_path / "archive"))
    universe = codes.where("code % 100 = 7")
    found = bar_source.scan_clustered_archive(spark, path, universe)
    assert found.count() == 200 and found.select("code").distinct().count() == 10
    assert "PartitionFilters: [slot" in found._jdf.queryExecution().executedPlan().toString()
    files = {r[0] for r in found.select("arrival.file_path").distinct().collect()}
    read = sum(spark.read.parquet(f.replace("file:", "")).count() for f in files)
    assert read <= 0.03 * 20_000  # rows of the files opened, for one code in a hundred
    plain = bar_source.scan_bar_archive(spark, path, universe)
    assert plain.count() == 200
    assert bar_source.scan_clustered_archive(spark, path, universe.limit(0)).count() == 0


# --- versioned tables

def test_versions_are_pinned_and_expire(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(versions.NoVersion):
        versions.snapshot(root)
    versions.commit(spark.range(3), root, 0)
    first = versions.snapshot(root)
    versions.update(spark, root, lambda old: old.where("id > 0"))
    versions.update(spark, root, lambda old: old.where("id > 1"), info={"rows": 1})
    assert first.read(spark).count() == 3 and versions.snapshot(root).read(spark).count() == 1
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(9), root, 2)
    assert versions.expire(root, keep=2) == [1] and versions.history(root) == [2, 3]
    assert versions.snapshot(root, 2).read(spark).count() == 2
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2
    table = versions.versions_table(spark, root).collect()
    assert [(r.version, r.base, json.loads(r.info)) for r in table] == [(2, 1, {}), (3, 2, {"rows": 1})]
    with pytest.raises(ValueError):
        versions.snapshot("s3://bucket/table")


def test_two_writers_race_and_neither_is_lost(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.commit(spark.range(1), root, 0)
    both_read = threading.Barrier(2, timeout=60)
    tries = []

    def writer(value):
        def change(old):
            if len(tries) < 2:  # both read version 1 before either commits
                tries.append(value)
                both_read.wait()
            else:
                tries.append(value)
            return old.unionByName(spark.range(value, value + 1))
        versions.update(spark, root, change)

    threads = [threading.Thread(target=writer, args=(v,)) for v in (10, 20)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(r.id for r in versions.snapshot(root).read(spark).collect()) == [0, 10, 20]
    assert versions.history(root) == [1, 2, 3] and len(tries) == 3


def bar(day, code, close):
    values = {"trade_date": day, "code": code, "close_qfq": close, "source_id": "S"}
    return tuple(values.get(f.name) for f in schemas.MARKET_DAILY.fields)


def test_merged_batches_are_published(spark, tmp_path):
    bars, facts = str(tmp_path / "bars"), str(tmp_path / "facts")
    d = dt.date
    old = spark.createDataFrame([bar(d(2020, 1, 2), "a", 1.0), bar(d(2021, 1, 4), "a", 2.0)], schemas.MARKET_DAILY)
    new = spark.createDataFrame([bar(d(2021, 1, 4), "a", 3.0), bar(d(2021, 1, 5), "b", 4.0)], schemas.MARKET_DAILY)
    ingest.publish_bars(spark, bars, ingest.load_batch(old), primary=True)
    done = ingest.publish_bars(spark, bars, ingest.load_batch(new), primary=False)
    assert done.version == 2 and done.info == {"rows": 2, "entities": 2}
    rows = done.read(spark)
    assert sorted((str(r.trade_date), r.code, r.close_qfq) for r in rows.collect()) == [
        ("2020-01-02", "a", 1.0), ("2021-01-04", "a", 3.0), ("2021-01-05", "b", 4.0)]
    text = ingest.merge_bars(rows, new, False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "(year#" in text
    fact = tuple({"code": "a", "report_period": d(2020, 3, 31), "ann_date": d(2020, 4, 1), "revision_id": "r"}.get(f.name)
                 for f in schemas.FINANCIAL_QUARTERLY.fields)
    batch = ingest.load_batch(spark.createDataFrame([fact], schemas.FINANCIAL_QUARTERLY))
    for _ in range(2):
        ingest.publish_facts(spark, facts, batch, True, None)
    assert versions.snapshot(facts).read(spark).count() == 1 and versions.history(facts) == [1, 2]


def test_a_batch_is_read_by_one_job(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    batch = spark.createDataFrame([(f"c{i % 4}", i) for i in range(100)], "code string, v int").mapInArrow(counted, "code string, v int")
    loaded = ingest.load_batch(batch)
    assert (loaded.rows, loaded.entities, read.value) == (100, 4, 100)
    table = loaded.batch.withColumn("trade_date", F.lit(dt.date(2020, 1, 1)))
    jobs = ingest.report(seeds.initial_jobs(spark), "J001", loaded, table, "trade_date", table)
    assert jobs.where("job_id = 'J001'").first().loaded_rows == 100 and read.value == 100
    assert ingest.load_batch(batch.limit(0)).rows == 0


# --- accounts of lines

def line(day, close=1.0):
    return f"{day},1,{close},2,0.5,10,20,0.1,0.2,0.3,0.4"


def test_every_line_has_an_account(spark):
    landed = [
        ("000001", line("2020-01-02"), 1), ("000001", line("2020-01-02", 5.0), 2), ("000001", "2020-01-03,1", 1), ("000001", None, 1),
        ("000002", line("2020-01-02"), 1), ("000002", line("2020-02-30"), 1), ("000003", line("2020-01-02"), 1),
        ("000008", line("2020-01-02", 7.0), 1), ("000008", line("2021-01-02", 8.0), 1), ("000009", line("2021-01-02", 9.0), 1),
    ]
    lines = spark.createDataFrame(landed, "code string, line string, arrival int")
    alias = spark.createDataFrame(
        [("000009", "000008", None, dt.date(2020, 6, 30), 1), ("000009", "000009", dt.date(2020, 7, 1), None, 2)],
        "canonical_code string, historical_code string, valid_from date, valid_to date, alias_rank int")
    universe = spark.createDataFrame([("000001",), ("000002",), ("000009",), ("000009",), ("000008",)], "code string")
    run = ingest.run_lines(lines, alias, universe)
    assert sorted((r.code, str(r.trade_date), r.close) for r in run.bars.collect()) == [
        ("000001", "2020-01-02", 5.0), ("000008", "2020-01-02", 7.0), ("000008", "2021-01-02", 8.0),
        ("000009", "2020-01-02", 7.0), ("000009", "2021-01-02", 9.0)]
    assert {(r.outcome, r.reason): r.lines for r in run.accounts.collect()} == {
        ("landed", None): 10, ("shared", None): 1, ("accepted", None): 5, ("superseded", None): 1, ("rejected", "short"): 2,
        ("rejected", "malformed"): 1, ("rejected", "payload"): 1, ("rejected", "universe"): 1}
    assert run.rejects.count() == 5
    with pytest.raises(ld.AccountError):
        ld.line_accounts(ld.routed_lines(ld.parsed_lines(lines), alias, universe), 11)
    empty = ingest.run_lines(lines.limit(0), alias, universe)
    assert empty.bars.count() == 0 and {r.lines for r in empty.accounts.collect()} == {0}


# --- pages

def page(told, *codes):
    return json.dumps({"result": {"pages": told, "data": [{"REPORTDATE": c} for c in codes]}})


def test_the_last_whole_fetch_counts(spark):
    landed = [
        ("a", 1, 1, 1, page(2, "x")), ("a", 1, 2, 2, page(2, "y")), ("a", 2, 2, 3, page(2, "z")),          # page 1 missing
        ("b", 1, 1, 1, page(3, "x")), ("b", 1, 2, 2, page(3)),                                          # ends with an empty page
        ("c", 1, 1, 1, page(2, "x")), ("c", 1, 2, 2, page(3, "x")), ("c", 1, 3, 3, page(3, "x")),          # mixed totals
        ("d", 1, 1, 1, page(1, "x")), ("d", 1, 1, 2, page(1, "y")),                                       # landed twice
        ("e", 1, 1, 1, '{"result":null}'), ("f", 1, 1, 1, "broken"), ("g", 1, 1, 1, page(3, "x")),
    ]
    pages = spark.createDataFrame(landed, "code string, fetch int, page int, arrival int, body string")
    kept, ledger = ingest.whole_pages(pages)
    got = {(r.code, r.fetch): (r.pages, r.told, r.repeats, r.missing, r.mixed, r.whole) for r in ledger.collect()}
    assert got == {
        ("a", 1): (2, 2, 0, 0, False, True), ("a", 2): (1, 2, 0, 1, False, False), ("b", 1): (2, 3, 0, 0, False, True),
        ("c", 1): (3, 3, 0, 0, True, False), ("d", 1): (1, 1, 1, 0, False, True), ("e", 1): (1, 1, 0, 0, False, True),
        ("f", 1): (1, 1, 0, 0, False, True), ("g", 1): (1, 3, 0, 2, False, False)}
    assert sorted((r.code, r.page, r.body) for r in kept.collect() if r.code in "ad") == [
        ("a", 1, page(2, "x")), ("a", 2, page(2, "y")), ("d", 1, page(1, "y"))]
    assert sorted(r.code for r in ld.incomplete_codes(ledger).collect()) == ["a", "c", "g"]


# --- exports

def test_exports_are_in_total_order(spark, tmp_path):
    rows = [((i * 7919) % 500 if i % 50 else None, f"n{i % 3}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(7)
    path = sinks.write_ordered_csv(df, str(tmp_path / "ordered"), ["k", "s"])
    assert sinks.order_breaks(spark, path, "k int, s string", ["k", "s"]).first().breaks == 0
    other = sinks.write_csv(df, str(tmp_path / "other"))
    assert sinks.order_breaks(spark, other, "k int, s string", ["k", "s"]).first().breaks > 100
    assert sinks.order_breaks(spark, sinks.write_csv(df.limit(0), str(tmp_path / "none")), "k int, s string", ["k"]).first().breaks == 0


def test_inserts_need_an_order_for_repeated_keys(spark):
    target = spark.createDataFrame([(1, "x")], "k int, v string")
    batch = spark.createDataFrame([(2, "a", 2), (2, "b", 1)], "k int, v string, at int")
    for insert, want in ((mg.insert_ignore, "b"), (mg.insert_or_replace, "a")):
        assert {r.k: r.v for r in insert(target, batch, ["k"], "at").collect()} == {1: "x", 2: want}
        with pytest.raises(Exception, match="repeats a key"):
            insert(target, batch.drop("at"), ["k"]).collect()


def test_packed_archive_reads_as_its_folder(spark, tmp_path):
    fields = "SECURITY_CODE,REPORT_DATE,NOTICE_DATE"
    files = {
        "000001.csv": [fields, "000001,2020-03-31,", '000001,"2020-06-30",2020-08-01', "000001"],
        "000002.csv": ["NOTICE_DATE,OTHER,SECURITY_CODE", "2020-08-01,x,000002", "", '2020-08-02,"a,b",000002'],
        "000003.csv": [fields, "1,2,3,4"], "000004.csv": [fields], "notes.csv": ["text", "more"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    rows = [(n, i, x) for n, lines in files.items() for i, x in enumerate(lines)]
    path = archive.write_packed(spark.createDataFrame(rows, "file string, place long, value string"), str(tmp_path / "packed"))
    packed = spark.read.parquet(path)
    index = archive.packed_files(packed)
    folder = str(tmp_path / "*.csv")
    keep = ["listing", "n_bytes", "parsed"]
    assert sorted(index.select(*keep).collect(), key=str) == sorted(archive.archive_files(spark, folder).select(*keep).collect(), key=str)
    good = "listing in ('000001', '000002', '000004')"
    got, want = (sorted((tuple(r) for r in d.where(good).drop("arrival").collect()), key=str)
                 for d in (archive.packed_records(packed, index), archive.archive_records(spark, folder)))
    assert got == want and len(got) == 5
